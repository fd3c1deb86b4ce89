"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW``, forwards and backwards, gives every position a distribution over the languages, and
a document the mean of its positions' distributions; the whole text is read. It is trained in numpy by backpropagation through time
on windows of at most ``PER_LANGUAGE`` documents of each language (those with the smallest hashed ids), the only rows that
come to the driver. The weights, a few kilobytes, go to the tasks; prediction moves no rows.

A text that is null or has no letter is ``und`` with score 0, whatever its language column says. Without any labelled text, all
are ``und``. Repeated rows are predicted each; a null id counts as held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from casewise.llm.common import fresh, held_out

HIDDEN, WINDOW, BATCH = 8, 256, 4096
PER_LANGUAGE, TRAIN_CHARS, STEPS, TRAIN_BATCH, RATE = 600, 128, 200, 128, 0.02
PARTS = 64
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def new_weights(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of both directions (``f`` and ``b``): bytes to gates, state to gates, reset state to candidate, state to classes."""
    rng, out = np.random.default_rng(seed), {"bias": np.zeros((classes, 1), np.float32)}
    for d in "fb":
        out[d + "E"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        out[d + "U"] = rng.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32)
        out[d + "V"] = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)
        out[d + "O"] = rng.normal(0, 0.3, (classes, hidden)).astype(np.float32)
    return out


def step(w: dict, d: str, x: np.ndarray, h: np.ndarray):
    """One time step of direction ``d`` for the bytes ``x``: gates, candidate and the new state, all (features, windows)."""
    n = h.shape[0]
    e = np.take(w[d + "E"], x, axis=1)
    gates = w[d + "U"] @ h
    gates += e[: 2 * n]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    candidate = w[d + "V"] @ (gates[n:] * h)
    candidate += e[2 * n :]
    np.tanh(candidate, out=candidate)
    return gates, candidate, h + gates[:n] * (candidate - h)


def softmax(logits):
    np.subtract(logits, logits.max(axis=0), out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _steps(length: int, d: str):
    return range(length) if d == "f" else range(length - 1, -1, -1)


def gradients(w: dict, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradient. ``x`` (time, windows), windows by descending size."""
    time, windows = x.shape
    active = [int((sizes > t).sum()) for t in range(time)]
    hidden, total = w["fU"].shape[1], max(1, int(sizes.sum()))
    trace, logits = {}, np.repeat(w["bias"][None], time, axis=0) + np.zeros((time, 1, windows), w["bias"].dtype)
    for d in "fb":
        h = np.zeros((hidden, windows), w["bias"].dtype)
        for t in _steps(time, d):
            n = active[t]
            before = h[:, :n].copy()
            gates, candidate, after = step(w, d, x[t, :n], before)
            h[:, :n] = after
            trace[d, t] = before, gates, candidate, after
            logits[t, :, :n] += w[d + "O"] @ after
    grads, loss = {k: np.zeros_like(v) for k, v in w.items()}, 0.0
    errors = []
    for t in range(time):
        n = active[t]
        p = softmax(logits[t, :, :n].copy())
        at = y[:n], np.arange(n)
        loss -= float(np.log(p[at] + 1e-12).sum())
        p[at] -= 1
        errors.append(p / total)
        grads["bias"] += errors[t].sum(axis=1, keepdims=True)
    for d in "fb":
        carried = np.zeros((hidden, windows), w["bias"].dtype)
        pushed, seen = [], []
        for t in reversed(_steps(time, d)):
            n = active[t]
            before, gates, candidate, after = trace[d, t]
            z, r = gates[:hidden], gates[hidden:]
            grads[d + "O"] += errors[t] @ after.T
            dh = w[d + "O"].T @ errors[t] + carried[:, :n]
            dc = dh * z * (1 - candidate * candidate)
            reset = w[d + "V"].T @ dc
            dg = np.concatenate([dh * (candidate - before) * z * (1 - z), reset * before * r * (1 - r)])
            grads[d + "V"] += dc @ (r * before).T
            grads[d + "U"] += dg @ before.T
            carried[:, :n] = dh * (1 - z) + reset * r + w[d + "U"].T @ dg
            pushed.append(np.concatenate([dg, dc]))
            seen.append(x[t, :n])
        pushed, seen = np.concatenate(pushed, axis=1), np.concatenate(seen)
        for i, row in enumerate(pushed):
            grads[d + "E"][i] = np.bincount(seen, row, 256)
    return loss / total, grads


def windows_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows: the text each belongs to, its start in the joined texts, its size; longest first."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // width)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + place * width
    sizes = np.minimum(width, lengths[owner] - place * width)
    order = np.argsort(-sizes, kind="stable")
    return owner[order], starts[order], sizes[order]


def _bytes_at(joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = starts[None, :] + np.arange(int(sizes[0]))[:, None]
    return joined[np.minimum(at, len(joined) - 1)]


def train(texts: list[str], labels: list[int], classes: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """``steps`` Adam steps over shuffled windows, with a rate that falls to zero."""
    coded = [t.encode("utf-8")[:WINDOW] for t in texts]
    keep = [i for i, t in enumerate(coded) if t]
    coded, y = [coded[i] for i in keep], np.array([labels[i] for i in keep])
    w, rng = new_weights(classes, seed=seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.empty(0, np.int64)
    for n in range(1, steps + 1):
        while len(order) < min(TRAIN_BATCH, len(coded)):
            order = np.concatenate([order, rng.permutation(len(coded))])
        picked, order = order[:TRAIN_BATCH], order[TRAIN_BATCH:]
        chosen = [coded[j] for j in picked]
        owner, starts, sizes = windows_of(chosen, WINDOW)
        x = _bytes_at(np.frombuffer(b"".join(chosen), np.uint8), starts, sizes)
        _, grads = gradients(w, x, sizes, y[picked][owner])
        for k, g in grads.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            w[k] -= RATE * (1 - n / (steps + 1)) * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def position_sums(w: dict, texts: list[bytes]) -> np.ndarray:
    """Per text, the sum over its positions of their distributions: (texts, classes)."""
    out = np.zeros((len(texts), len(w["bias"])))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    owner, starts, sizes = windows_of(texts, WINDOW)
    hidden = w["fU"].shape[1]
    for i in range(0, len(owner), BATCH):
        own, size = owner[i : i + BATCH], sizes[i : i + BATCH]
        x = _bytes_at(joined, starts[i : i + BATCH], size)
        active = np.searchsorted(-size, -np.arange(len(x)), side="left")  # windows longer than t stand first
        forward, sums = [], np.zeros((len(w["bias"]), len(own)), np.float32)
        for d in "fb":
            h = np.zeros((hidden, len(own)), np.float32)
            for t in _steps(len(x), d):
                n = active[t]
                # a full block needs no copy of its part that is active
                state = step(w, d, x[t, :n], h[:, :n])[2]
                if n == len(own):
                    h = state
                else:
                    h[:, :n] = state
                if d == "f":
                    logits = w["fO"] @ state
                    logits += w["bias"]
                    forward.append(logits)
                else:
                    logits = forward[t]
                    logits += w["bO"] @ state
                    sums[:, :n] += softmax(logits)
        for c in range(len(sums)):
            out[:, c] += np.bincount(own, sums[c], len(texts))
    return out


def training_rows(docs: DataFrame, text: str, lang: str, key: str, per_language: int) -> DataFrame:
    """At most ``per_language`` documents of each language outside the held-out fifth; of each a passage from its middle."""
    known = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang")).filter(
        ~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    middle = F.greatest(F.floor(F.char_length("text") / 2) - TRAIN_CHARS // 2, F.lit(0)) + 1
    order = F.xxhash64(F.col("key").cast("string")).alias("order")
    passages = known.select("lang", order, "key", F.substr("text", middle.cast("int"), F.lit(TRAIN_CHARS)).alias("text"))
    # The smallest hashes of each of many parts of a language, then those of the language: no task meets all rows of one.
    for part in (["lang", F.pmod("order", F.lit(PARTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy("order", "key", "text"))
        passages = passages.withColumn("place", place).filter(F.col("place") <= per_language)
    return passages.select("lang", "place", "text")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> tuple[list[str], dict]:
    rows = sorted(map(tuple, training_rows(docs, text, lang, key, per_language).collect()))
    names = sorted({r[0] for r in rows})
    return names, train([r[2] for r in rows], [names.index(r[0]) for r in rows], len(names)) if names else {}


def predict(docs: DataFrame, names: list[str], weights: dict, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two new columns, renamed where a name is taken."""
    language = fresh(docs, language)
    score = fresh(docs, score)
    schema = StructType([*docs.schema.fields]).add(language, "string", False).add(score, "double", False)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            read = [t.encode("utf-8") if names and LETTER.search(t) else b"" for t in texts]
            sums = position_sums(weights, read) if any(read) else np.zeros((len(read), 1))
            best = sums.argmax(axis=1)
            shares = [float(min(1.0, s[b] / len(t))) if t else 0.0 for t, s, b in zip(read, sums, best)]
            found = [names[b] if t else UNKNOWN for t, b in zip(read, best)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(shares, pa.float64())],
                                             [*batch.schema.names, language, score])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Trained and predicted on the same table: key, ``held_out``, ``lang_pred``, ``score``."""
    names, weights = fit(docs, text, lang, key)
    narrow = docs.select(docs[key].alias("key"), held_out(docs[key]).alias("held_out"), docs[text].alias("text"))
    return predict(narrow, names, weights).select(F.col("key").alias(key), "held_out", "lang_pred", "score")
