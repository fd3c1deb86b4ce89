"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The merge procedure has a unique result for every prefix of a word, so for each prefix only its last token needs storing. A
suffix automaton of the vocabulary lists the tokens that end at a position, longest first; a token may follow the stored last token
of the shorter prefix exactly if the merge procedure would leave the two apart (``Codec.apart``). One such token exists for
each prefix, and the back-pointers from the whole word give the ids. No merge queue is run.

Texts follow the tokenizer file: special tokens are taken out first, then NFC, lower case, white space dropped, words by the
file's pattern, bytes by the usual byte-to-letter table. Words repeat, so results are remembered in a table of bounded size.
A null text counts as empty: no ids, empty decoded text.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from casewise.llm.common import fresh

TOKENIZER = "word_bpe_49k.json"
WORDS_HELD = 1_000_000
PAIRS_HELD = 500_000
# White space as the tokenizer files' patterns understand it; str.split() also takes the four separators \x1c-\x1f.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
SHORT = 64  # words of at most so many bytes are encoded many at a time
BLOCK = 1 << 14
KNOWN_BITS = 18
BATCH_CHARS = 4_000_000
BREAK = b"\xff\xff"  # stands between chunks; no id
END = 256  # symbol of a byte that ends its word: the byte plus END


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


def read_tables(path: str) -> dict:
    """What the encoder needs from a tokenizer file; plain containers, so that it can be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
    if model["type"] != "BPE" or not suffix or model.get("ignore_merges") or model.get("byte_fallback"):
        raise ValueError("a BPE file with an end-of-word suffix is expected")
    letter = {c: b for b, c in enumerate(byte_letters())}

    def symbols(token: str) -> tuple[int, ...]:
        ends = token.endswith(suffix) and token != suffix
        out = [letter[c] for c in (token[: -len(suffix)] if ends else token)]
        if ends:
            out[-1] += END
        return tuple(out)

    vocab = model["vocab"]
    strings = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for token, i in vocab.items():
        strings[i] = token
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token, i in special.items():
        strings[i] = token
    pairs, halves, rank = {}, {}, {}
    for order, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        left, right, whole = vocab[a], vocab[b], vocab[a + b]
        pairs[left, right] = whole
        halves[whole], rank[whole] = (left, right), order
    spelled = {i: symbols(t) for t, i in vocab.items() if t not in special}
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {"strings": strings, "special": special, "pairs": pairs, "halves": halves, "rank": rank, "spelled": spelled, "pattern": pattern}


class SuffixAutomaton:
    """Generalised suffix automaton of the tokens' symbol strings; ``ends(state)`` lists the tokens that end there."""

    def __init__(self, spelled: dict[int, tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for symbols in spelled.values():
            last = 0
            for s in symbols:
                last = self._extend(last, s)
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for token, symbols in spelled.items():
            state = 0
            for s in symbols:
                state = self.next[state][s]
            own[state].append((len(symbols), token))
        self.own = [tuple(sorted(x, reverse=True)) for x in own]
        self._ends: dict[int, tuple] = {}

    def _extend(self, last: int, s: int) -> int:
        next_, link, length = self.next, self.link, self.length
        if s in next_[last]:
            q = next_[last][s]
            return q if length[q] == length[last] + 1 else self._clone(last, s, q)
        new = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and s not in next_[p]:
            next_[p][s] = new
            p = link[p]
        if p != -1:
            q = next_[p][s]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, s, q)
        return new

    def _clone(self, p: int, s: int, q: int) -> int:
        next_, link = self.next, self.link
        copy = len(next_)
        next_.append(dict(next_[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and next_[p].get(s) == q:
            next_[p][s] = copy
            p = link[p]
        return copy

    def ends(self, state: int) -> tuple:
        """(length, token) of all tokens that are suffixes of the state's longest string, longest first."""
        found = self._ends.get(state)
        if found is None:
            found = self._ends[state] = self.own[state] + (self.ends(self.link[state]) if state else ())
        return found


class _Remembered(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class _Table:
    """Numbers looked up by key, many at a time: open addressing in arrays."""

    def __init__(self, keys, values, absent: int):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        self.bits, self.absent = max(4, int(np.ceil(np.log2(2 * len(keys) + 4)))), absent
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, absent, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = left[self.keys[slots[left]] == -1]
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots[left]] == keys[left]
            self.values[slots[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys):
        slots = self._slot(keys)
        seen = self.keys[slots]
        found = np.where(seen == keys, self.values[slots], self.absent)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        while left.size:
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[left]]
            hit = seen == keys[left]
            found[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (seen != -1)]
        return found


class BlockCoder:
    """The same dynamic programme over many short words at once: position by position, arrays over the words."""

    def __init__(self, codec: Codec):
        automaton, n = codec.automaton, len(codec.strings)
        moves = [(state * 512 + s, to) for state, row in enumerate(automaton.next) for s, to in row.items()]
        self.move = _Table(*zip(*moves), absent=-1)
        self.link, self.length = np.array(automaton.link), np.array(automaton.length)
        ends = [automaton.ends(state) for state in range(len(automaton.next))]
        self.first_end = np.cumsum([0, *map(len, ends)])
        self.end_size, self.end_token = np.array([x for e in ends for x in e], np.int64).reshape(-1, 2).T
        self.crossing = _Table([a << 16 | b for a, b in codec.pairs], [codec.rank[t] for t in codec.pairs.values()], absent=1 << 30)
        self.rank, self.left, self.right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for token, (a, b) in codec.halves.items():
            self.rank[token], self.left[token], self.right[token] = codec.rank[token], a, b
        self.known = np.full(1 << KNOWN_BITS, -1, np.int64)  # pairs tested lately and what came out, by hash
        self.size = np.zeros(n, np.int64)
        self.size[self.end_token] = self.end_size

    def apart(self, left, right):
        """``Codec.apart`` for arrays of pairs."""
        good = np.ones(len(left), bool)
        at, latest = np.arange(len(left)), np.full(len(left), 1 << 29)
        while at.size:
            bad = self.crossing[left << 16 | right] < latest
            good[at[bad]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~bad & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            undo_left = a > b
            latest = np.where(undo_left, a, b + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
        return good

    def follows(self, left, right):
        """``apart``, remembering pairs: most tests repeat."""
        pair = left << 16 | right
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        seen = self.known[slot]
        good = (seen & 1).astype(bool)
        new = np.flatnonzero(seen >> 1 != pair)
        if len(new):
            good[new] = self.apart(left[new], right[new])
            self.known[slot[new]] = pair[new] << 1 | good[new]
        return good

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space, none empty, at most ``SHORT`` bytes each."""
        text = np.frombuffer("\n".join([*words, ""]).encode("utf-8"), np.uint8)
        stops = np.flatnonzero(text == 10)
        sizes = np.diff(np.concatenate([[-1], stops])) - 1
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], (stops - sizes)[order]
        n, longest = len(words), int(sizes[0])
        last = np.full((longest + 1, n), -1, np.int64)  # of each prefix: its last token
        state, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(longest):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # words longer than i stand first
            symbol = text[starts[:n] + i] + np.where(sizes[:n] == i + 1, END, 0)
            to = self.move[state[:n] * 512 + symbol]
            while (left := np.flatnonzero(to < 0)).size:
                if (state[left] == 0).any():
                    raise ValueError("a symbol is not in the vocabulary")
                state[left] = self.link[state[left]]
                held[left] = self.length[state[left]]
                to[left] = self.move[state[left] * 512 + symbol[left]]
            state[:n] = to
            held[:n] += 1
            todo, end = np.arange(n), self.first_end[to]
            while todo.size:
                size, token = self.end_size[end], self.end_token[end]
                before = last[np.maximum(i + 1 - size, 0), todo]
                good = size <= held[todo]
                test = np.flatnonzero(good & (before >= 0))
                good[test] = self.follows(before[test], token[test])
                last[i + 1, todo[good]] = token[good]
                todo, end = todo[~good], end[~good] + 1
        place, every, steps = sizes.copy(), np.arange(len(words)), []
        while (place > 0).any():
            token = np.where(place > 0, last[place, every], -1)
            steps.append(token)
            place = np.where(place > 0, place - self.size[token], 0)
        table = np.array(steps[::-1]).T[np.argsort(order, kind="stable")]
        used = table >= 0
        blob = table[used].astype("<u2").tobytes()
        cuts = (2 * np.cumsum([0, *used.sum(axis=1)])).tolist()
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, tables: dict):
        self.strings, self.special = tables["strings"], tables["special"]
        self.pairs, self.halves, self.rank = tables["pairs"], tables["halves"], tables["rank"]
        self.word = regex.compile(tables["pattern"])
        self.words_or_breaks = regex.compile(tables["pattern"] + r"|\n")
        if len(self.strings) >= 0xFFFF:
            raise ValueError("ids must be smaller than the break between chunks")
        self.stop = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.following = _Remembered(lambda pair: self.apart(*pair), PAIRS_HELD)
        spelled = tables["spelled"]
        # A token that the merges never leave whole can't be in any result.
        usable = {t: s for t, s in spelled.items() if t not in self.halves or self.whole(t)}
        self.automaton = SuffixAutomaton(usable)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.numbers = list(map(str, range(len(self.strings))))
        self.block = BlockCoder(self)

    def apart(self, left: int, right: int) -> bool:
        """Would the merges leave the two neighbouring tokens as they are?

        Undoes the two tokens' merges, latest first. At each step the merge of the two pieces that touch must come later than the
        merge just undone; of equal merges the one further left is first.
        """
        pairs, halves, rank = self.pairs, self.halves, self.rank
        latest = len(rank) + 1  # a crossing merge of a lower rank would have come first
        while True:
            crossing = pairs.get((left, right))
            if crossing is not None and rank[crossing] < latest:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                latest, left = a, halves[left][1]
            else:
                latest, right = b + 1, halves[right][0]

    def whole(self, token: int) -> bool:
        """Do the merges make this token of its own symbols? True if its halves are and only its own merge joins them."""
        left, right = self.halves[token]
        pairs, halves, rank = self.pairs, self.halves, self.rank
        own, latest, a_token, b_token = rank[token], rank[token], left, right
        while True:
            crossing = pairs.get((a_token, b_token))
            if crossing is not None and rank[crossing] < latest and (a_token, b_token) != (left, right):
                return False
            a, b = rank.get(a_token, -1), rank.get(b_token, -1)
            if max(a, b) >= own:
                return False
            if a < 0 and b < 0:
                return all(t not in halves or self.whole(t) for t in (left, right))
            if a > b:
                latest, a_token = a, halves[a_token][1]
            else:
                latest, b_token = b + 1, halves[b_token][0]

    def _encode_word(self, word: str) -> bytes:
        symbols = list(word.encode("utf-8"))
        symbols[-1] += END
        automaton, following = self.automaton, self.following
        next_, link, length, ends = automaton.next, automaton.link, automaton.length, automaton._ends
        last, back = [-1], [0]  # of each prefix: its last token, and where that token starts
        state = held = 0
        for i, s in enumerate(symbols, 1):
            while s not in next_[state]:
                if not state:
                    raise ValueError(f"symbol {s} is not in the vocabulary")
                state = link[state]
                held = length[state]
            state = next_[state][s]
            held += 1
            for size, token in ends.get(state) or automaton.ends(state):
                if size <= held:
                    before = last[i - size]
                    if before < 0 or following[before, token]:
                        last.append(token)
                        back.append(i - size)
                        break
        ids, i = [], len(symbols)
        while i:
            ids.append(last[i])
            i = back[i]
        return np.array(ids[::-1], "<u2").tobytes()

    def learn(self, new: set[str]) -> None:
        """Encodes new chunks together and remembers them; both tables are emptied before they outgrow their bounds."""
        if not new:
            return
        if len(self.chunks) + len(new) > WORDS_HELD:
            self.chunks.clear()
            self.words.clear()
        order = list(new)
        flat = self.words_or_breaks.findall("\n".join([*order, ""]))
        unseen = set(flat).difference(self.words)
        unseen.discard("\n")
        if len(self.words) + len(unseen) > WORDS_HELD:
            self.words.clear()
            unseen = set(flat)
            unseen.discard("\n")
        # This block's words stay until it is joined, also if they alone exceed the bound: nothing is dropped in between.
        short = [w for w in unseen if len(w) <= SHORT // 4]
        for i in range(0, len(short), BLOCK):
            block = short[i : i + BLOCK]
            self.words.update(zip(block, self.block.encode(block)))
        self.words.update([(w, self._encode_word(w)) for w in unseen if len(w) > SHORT // 4])
        self.words["\n"] = BREAK
        blob = b"".join(map(self.words.__getitem__, flat))
        stops = (2 * np.flatnonzero(np.frombuffer(blob, "<u2") == 0xFFFF)).tolist()
        self.chunks.update(zip(order, [blob[a:b] for a, b in zip([0, *(x + 2 for x in stops)], stops)]))
        if len(self.words) > WORDS_HELD:
            self.words.clear()

    def chunked(self, text: str) -> list[str]:
        """Normalised text without special tokens, cut at white space."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # The file lower-cases letter by letter: no final sigma.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return [x for x in SPACE.split(text) if x] if any(c in text for c in SEPARATORS) else text.split()

    def encode_all(self, texts) -> Iterator[np.ndarray]:
        """Token ids of each text as unsigned 16-bit numbers; a null text has none."""
        held, size, new = [], 0, set()
        for text in texts:
            parts = self.stop.split(text or "") if self.stop and self.stop.search(text or "") else [text or ""]
            out = []
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(([], [np.array([self.special[part]], "<u2").tobytes()], []))
                    continue
                chunks = self.chunked(part)
                found = list(map(self.chunks.get, chunks))
                missing = [k for k, ids in enumerate(found) if ids is None]
                new.update([chunks[k] for k in missing])
                out.append((chunks, found, missing))
            held.append(out)
            size += len(text or "")
            if size >= BATCH_CHARS:
                yield from self._finish(held, new)
                held, size, new = [], 0, set()
        yield from self._finish(held, new)

    def _finish(self, held, new) -> Iterator[np.ndarray]:
        self.learn(new)
        for out in held:
            for chunks, found, missing in out:
                for k in missing:
                    found[k] = self.chunks[chunks[k]]
            yield np.frombuffer(b"".join([ids for _, found, _ in out for ids in found]) if len(out) > 1 else b"".join(out[0][1]), "<u2")

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids) -> str:
        """The tokens joined by blanks, special ones included: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def shared_codec(spark, path: str):
    """A function for tasks that gives the codec, built once in each Python worker from broadcast tables.

    The tables' size is that of the tokenizer file, whatever the data."""
    tables, name = spark.sparkContext.broadcast(read_tables(path)), path

    def get() -> Codec:
        if name not in _CODECS:
            _CODECS.clear()
            _CODECS[name] = Codec(tables.value)
        return _CODECS[name]

    return get


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    return (x.as_py() for x in batch.column(column))


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new column (renamed if the name is taken)."""
    codec, name = shared_codec(docs.sparkSession, path), fresh(docs, ids)
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType(), False), False)])

    def run(batches):
        for batch in batches:
            coded = list(codec().encode_all(texts_of(batch, text)))
            ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, "<u2"), *coded]).astype(np.int32))
            column = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in a new column; null ids give an empty text."""
    codec, name = shared_codec(docs.sparkSession, path), fresh(docs, decoded)
    schema = StructType([*docs.schema.fields, StructField(name, StringType(), False)])

    def run(batches):
        decode = codec().decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())],
                                             [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes, decodes the ids, and keeps digests of both: one row per document, no ids leave the task."""
    codec = shared_codec(docs.sparkSession, path)

    def run(batches):
        c = codec()
        for batch in batches:
            rows = []
            for coded in c.encode_all(texts_of(batch, "text")):
                ids = coded.tolist()
                numbers = " ".join(map(c.numbers.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.string())))],
                                             [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return narrow.mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
