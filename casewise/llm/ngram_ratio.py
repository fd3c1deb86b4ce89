"""Quality rules: counts of words, symbols and repeats, then a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Tokens are runs of letters and digits, or of other signs, without regard to the case of A-Z. Each token and each pair of neighbouring tokens of
a text falls into one of ``BUCKETS`` hash buckets. One pass counts the buckets over all documents (the raw corpus) and over the trusted ones; the add-one
smoothed log2 ratio of the two multinomials is held as an integer of ``SCALE`` to the bit. A document's score is the sum over its n-grams, divided by their
number, and every document whose score reaches ``FLOOR`` passes: no sampling, no ties to break, the same verdict for the same text.

The trusted target is every document labelled good and not toxic; nothing is sampled. Their texts alone are moved, to be joined
with the labels; a bitmap of fixed size and twice ``BUCKETS`` numbers come to the driver.

Defined results. A null text has no words; it and a text without words have zero counts and fail the base rules. A null id is never trusted;
repeated rows count as often as they stand. Without trusted documents, or without any n-gram, all ratios come from smoothing alone and are zero or nearly so.
Texts are read whole, one at a time with its own n-grams; a table without rows gives none. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.bounded_filter import LISTS, fold_filter, pack_all, passes
from casewise.llm.shingles import chunks_of

BUCKETS = 1 << 14
SCALE = 1 << 16
FLOOR = -0.5
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5

# Signs that count as symbols, and the blanks between words.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"

_BLANK, _LETTER, _SIGN = 0, 1, 2
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[list(BLANKS)] = _BLANK
_KIND[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = _LETTER
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS)).astype(np.int64)
_IS_POINT = ((_KIND != _BLANK) & (np.arange(256) & 0xC0 != 0x80)).astype(np.int64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32

# Odd multipliers below 2^62: of a byte's place in a token, of a token alone, of the first and the second of two.
PLACE, ALONE, FIRST, SECOND = 0x1E3779B97F4A7C15, 0x36E8FEB86659FD93, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51
_powers: dict[str, np.ndarray] = {}


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        for name, factor in (("up", PLACE), ("down", pow(PLACE, -1, 1 << 64))):
            table = np.full(max(size, 1 << 21), factor, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"][:size], _powers["down"][:size]


def _bytes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text followed by a line end, and where each begins (and the end)."""
    each = [(t or "").encode() for t in texts]
    cuts = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in each], out=cuts[1:])
    return np.frombuffer(b"".join(part for x in each for part in (x, b"\n")), np.uint8), cuts


def ngram_buckets(data: np.ndarray, cuts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each token and each pair of neighbouring tokens. Tokens take the lower half of the buckets, pairs the upper."""
    kind = _KIND[data]
    turn = np.flatnonzero(np.diff(kind, prepend=np.uint8(_BLANK)))
    starts = turn[kind[turn] != _BLANK]
    stops = turn[np.searchsorted(turn, starts) + 1]  # a line end follows each text
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:-1], out=sums[1:])
    token = (sums[stops] - sums[starts]) * down[starts]
    owner = np.searchsorted(cuts, starts, side="right") - 1
    half, top = np.uint64(buckets // 2), np.uint64(40)
    single = (token * np.uint64(ALONE)) >> top
    pair = (token[:-1] * np.uint64(FIRST) + token[1:] * np.uint64(SECOND)) >> top
    inside = owner[:-1] == owner[1:]
    return np.concatenate([single % half, half + pair[inside] % half]).astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of ``WINDOW`` words that the text holds at least twice."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, reached = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + WINDOW - max(at, reached)
            reached = at + WINDOW
    return covered


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS.decode())]
    return len(lines) - len(set(lines))


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The columns of consecutive rows of about a megabyte of text; ``text`` is the first."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        for first, texts in chunks_of(columns[0]):
            yield [texts, *[c[first : first + len(texts)] for c in columns[1:]]]


def _total(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in all texts of ``docs``."""

    def count(batches):
        held = np.zeros(buckets, np.int64)
        for (texts,) in _columns(batches, "text"):
            held += np.bincount(ngram_buckets(*_bytes_of(texts), buckets)[0], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


def _of_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``trusted``. A bitmap of the ids' hashes holds back the others before the join moves texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = lambda df: df.withColumn("key", F.xxhash64("doc_id"))
    keys = lambda batch: batch.column("key").to_numpy().view(np.uint64)
    ids = trusted.select(F.col("doc_id").cast(kind).alias("doc_id"))
    bitmap = fold_filter(keyed(ids).select("key").mapInArrow(lambda batches: pack_all(map(keys, batches)), LISTS), 1)

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(bitmap.value, keys(batch)))).select(["doc_id", "text"])

    likely = keyed(docs.select("doc_id", "text")).mapInArrow(pick, f"doc_id {kind}, text string")
    return likely.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def count_buckets(docs: DataFrame, trusted: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket stands in all texts of ``docs``, and in those whose ``doc_id`` is in ``trusted``."""
    return _total(docs, buckets), _total(_of_trusted(docs, trusted), buckets)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log2 of target share over raw share of each bucket, in units of 1 / ``SCALE``. Tokens and pairs are multinomials of their own."""
    half, out = len(raw) // 2, np.zeros(len(raw), np.int64)
    for part in (slice(0, half), slice(half, None)):
        share = [np.log2((c[part] + 1) / (c[part].sum() + half)) for c in (target, raw)]
        out[part] = np.floor((share[0] - share[1]) * SCALE + 0.5)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, floor: float = FLOOR) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept``, and ``score`` in bits an n-gram (null without n-grams)."""
    ratios = log_ratios(*count_buckets(docs, trusted_ids(labels), buckets))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_ngrams", "ratio"]

    def measure(batches):
        for texts, ids in _columns(batches, "text", "doc_id"):
            data, cuts = _bytes_of(texts)
            found, owner = ngram_buckets(data, cuts, buckets)
            ratio = np.zeros(len(texts), np.int64)
            np.add.at(ratio, owner, ratios[found])
            words = [(t or "").encode().split() for t in texts]
            values = [
                np.array([len(w) for w in words]), _sums(_IS_POINT[data], cuts), _sums(_IS_SYMBOL[data], cuts),
                np.array([repeated_lines(t or "") for t in texts]), np.array([repeated_words(w) for w in words]),
                np.bincount(owner, minlength=len(texts)), ratio]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(v.astype(np.int64)) for v in values]], names)

    measured = docs.select("doc_id", "text").mapInArrow(measure, ", ".join(f"{n} long" for n in names))
    few, repeats = F.col("n_words") < LEAST_WORDS, 100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")
    likely = F.col("ratio") >= F.lit(int(np.floor(floor * SCALE))) * F.col("n_ngrams")
    return measured.select(
        *names[:6], (few | repeats).alias("base_failed"), (~(few | repeats) & likely).alias("kept"),
        F.when(F.col("n_ngrams") > 0, F.col("ratio") / (SCALE * F.col("n_ngrams"))).alias("score"))
