"""Source divergence audit: how far the word use of each (language, source) group is from other sources and from its whole language.

Counting is a sort of pointers. In each task, slices of consecutive texts are read straight from the Arrow buffers: the first bytes of the words are the
pointers, and a multikey quicksort puts them in the order of the words they point to. Its "characters" are ``CHUNK`` bytes. Pointers with equal
words are a run; a run's length, its distinct documents and its sources are the counts. Spark adds up the slices' runs on the map side, so what moves is
one row per word, group and task, and a group with a third of all rows is as many rows as any other with the same words.

Shares are integers of ``UNIT``: ``p = 1 + UNIT * (count + 1) div (N + V)``, and the divergence of p from q is ``(p - q)^2 div q``, all exact.
Pairs of sources are added up per shard of about ``SHARD`` words, on a grid of blocks of about ``BLOCK`` sources: a task holds a matrix of
words of its shard by sources of two blocks, whatever their numbers, and returns one sum per pair.

Defined results. Null text, language and source count as empty. A group without words has rows for its pairs all the same. A language without
kept words has pairs of value 0. Repeated rows are documents of their own. Ties go to the bytewise smaller item. A table without rows gives none.
Columns other than ``text``, ``lang`` and ``source`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewise.llm.common import write_table

UNIT = 1_000_000_000
LEAST_DOCS, TOP_TERMS = 3, 200
SLICE_BYTES = 1 << 23
CHUNK, PARTITION_FROM, TOGETHER_BELOW = 8, 1 << 14, 1 << 8
SHARD, BLOCK, MATRIX_ROWS = 5_000, 128, 2_048

# Bytes of words are letters of ASCII and whatever stands outside ASCII; A-Z count as a-z.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([0, *[((1 << 8 * k) - 1) << 8 * (CHUNK - k) for k in range(1, CHUNK + 1)]], np.uint64)


def word_pointers(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of all words; no word crosses one of the ``cuts`` between texts."""
    inside = _IN_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1 - starts


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """The bytes ``CHUNK * depth`` and following of each word as a number whose order is that of the bytes; an ended word has zeros."""
    at = np.minimum(starts + CHUNK * depth, len(data) - CHUNK)
    keys = np.lib.stride_tricks.sliding_window_view(data, CHUNK)[at].view(">u8").ravel().astype(np.uint64)
    return keys & _MASKS[np.clip(sizes - CHUNK * depth, 0, CHUNK)]


def _quicksort(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Three-way partitions around medians of samples until pieces are small; the pieces are left to the caller, equal pieces are done."""
    order, stack, small = np.arange(len(keys)), [(0, len(keys))], []
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= PARTITION_FROM:
            small.append((lo, hi))
            continue
        part = order[lo:hi]
        own = keys[part]
        pivot = np.sort(own[:: max(1, len(own) // 31)])[15]
        less, more = own < pivot, own > pivot
        a, b = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        stack += [(lo, lo + a), (hi - b, hi)]
    return order, [piece for piece in small if piece[1] > piece[0]]


def sort_pointers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the words' numbers in the order of the words, equal ones as they stood, and where the runs of equal words begin."""
    data = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    order, depth = np.arange(len(starts)), 0
    begins = np.zeros(len(starts), bool)
    begins[:1] = True
    open_at = np.arange(len(starts))  # places in the order whose runs may differ further on
    while len(open_at):
        held = order[open_at]
        keys = _keys(data, starts[held], sizes[held], depth)
        run = np.cumsum(begins[open_at])
        cuts = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(run))
        wide = np.flatnonzero(np.diff(cuts) >= TOGETHER_BELOW)
        sorted_at, narrow = np.arange(len(held)), np.ones(len(held), bool)
        for lo, hi in zip(cuts[wide], cuts[wide + 1]):
            narrow[lo:hi] = False
            inner, pieces = _quicksort(keys[lo:hi])
            for a, b in pieces:
                inner[a:b] = inner[a:b][np.argsort(keys[lo:hi][inner[a:b]], kind="stable")]
            sorted_at[lo:hi] = lo + inner
        few = np.flatnonzero(narrow)  # all runs of a few pointers at once
        sorted_at[few] = few[np.lexsort((keys[few], run[few]))]
        order[open_at], keys = held[sorted_at], keys[sorted_at]
        begins[open_at[1:]] |= keys[1:] != keys[:-1]
        begins[open_at[cuts[:-1]]] = True
        depth += 1
        ends = np.append(begins[1:], True)
        alone = begins & ends
        open_at = open_at[~alone[open_at]]
        longer, run = sizes[order[open_at]] > CHUNK * depth, np.cumsum(begins[open_at])
        open_at = open_at[np.bincount(run, weights=longer)[run] > 0] if len(run) else run  # an ended word stays with longer ones that begin so
    return order, begins


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes and cuts of consecutive texts of about ``SLICE_BYTES``, and their rows; the bytes are a view of the Arrow buffer."""
    text = batch.column("text")
    _, places, held = text.buffers()
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    places = np.frombuffer(places, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    held, first = np.frombuffer(held or b"", np.uint8), 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(places, places[first] + SLICE_BYTES, side="right")) - 1)
        yield held[places[first] : places[last]], places[first : last + 1] - places[first], first, last
        first = last


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang source term n docs`` of each slice; columns ``text lang source`` without nulls."""
    for batch in batches:
        group, names = pd.factorize(pd.MultiIndex.from_arrays([batch.column("lang").to_pandas(), batch.column("source").to_pandas()]))
        langs, sources = (pa.array(names.get_level_values(k), pa.string()) for k in (0, 1))
        for data, cuts, first, last in _slices(batch):
            data = _LOWER[data]
            starts, sizes = word_pointers(data, cuts)
            if not len(starts):
                continue
            order, begins = sort_pointers(data, starts, sizes)
            # Documents renumbered group by group, so that one sort within the runs puts both documents and groups together.
            by_group = np.argsort(group[first:last], kind="stable")
            number = np.empty(last - first, np.int64)
            number[by_group] = np.arange(last - first)
            run = np.cumsum(begins) - 1
            doc = number[np.searchsorted(cuts, starts[order], side="right") - 1]
            both = np.sort(run * (last - first) + doc)
            run, doc = np.divmod(both, last - first)
            new_doc = np.append(True, both[1:] != both[:-1])
            own = group[first:last][by_group][doc]
            new = np.append(True, (run[1:] != run[:-1]) | (own[1:] != own[:-1]))
            at = np.flatnonzero(new)
            head = order[np.flatnonzero(begins)][run[at]]
            lengths = sizes[head]
            ends = np.cumsum(lengths)
            spread = np.arange(ends[-1]) + np.repeat(starts[head] - (ends - lengths), lengths)
            terms = pa.StringArray.from_buffers(len(head), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[spread]))
            counts = np.diff(np.append(at, len(both)))
            docs = np.add.reduceat(new_doc.astype(np.int64), at)
            whose = pa.array(own[at])
            yield pa.RecordBatch.from_arrays(
                [langs.take(whose), sources.take(whose), terms, pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + UNIT * (count + 1) div (total + kept)``, exact whatever the count."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + kept).cast("decimal(20,0)"))


def _sum_pairs(key: tuple, entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Of the words of one shard: the sum of each pair of sources of two blocks; words that none of them has are added in shard 0."""
    _, low, high, shard = key
    groups = groups.sort_values("source")
    names = pd.Index(groups["source"])
    rest, block, kept = groups["p0"].to_numpy(np.int64), groups["block"].to_numpy(), int(groups["kept"].iloc[0])
    if kept:
        flat = (rest[:, None] - rest) ** 2 // rest
        sums = flat * kept if shard == 0 else np.zeros_like(flat)
        word, words = pd.factorize(entries["term"])
        source, p = names.get_indexer(entries["source"]), entries["p"].to_numpy(np.int64)
        turn = np.argsort(word, kind="stable")
        cuts = np.searchsorted(word[turn], np.arange(0, len(words) + MATRIX_ROWS, MATRIX_ROWS))
        for first, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            own = turn[a:b]
            if not len(own):
                continue
            shares = np.tile(rest, (min(MATRIX_ROWS, len(words) - first * MATRIX_ROWS), 1))
            shares[word[own] - first * MATRIX_ROWS, source[own]] = p[own]
            for k in range(len(rest)):
                sums[k] += ((shares[:, k : k + 1] - shares) ** 2 // shares - flat[k]).sum(axis=0)
    else:
        sums = np.zeros((len(rest), len(rest)), np.int64)
    a, b = np.nonzero(~np.eye(len(rest), dtype=bool) & ((low == high) | (block[:, None] != block)))
    return pd.DataFrame({"lang": key[0], "source": names[a], "item": names[b], "value": sums[a, b]})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Columns ``lang source part item value rank``: part ``pair`` ranks a group's divergence from each other source of its language,
    part ``term`` its ``top`` words that are more frequent in it than in the language. Words stand in at least ``least_docs`` documents of their language."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = texts.mapInArrow(count_words, "lang string, source string, term string, n long, docs long")
    counts = write_table(runs.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = write_table(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"))
    entries = counts.drop("docs").join(kept, ["lang", "term"])

    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_n"))
    used = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = texts.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "kept", "lang_n"])
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    blocks, shards = F.ceil(F.col("sources") / block), F.greatest(F.ceil(F.col("kept") / shard), F.lit(1))
    groups = write_table(groups.join(per_lang, "lang").select(
        "lang", "source", "group_n", "kept", "lang_n", blocks.alias("blocks"), shards.alias("shards"), F.pmod(F.xxhash64("source"), blocks).alias("block"),
        F.when(F.col("kept") > 0, _share(F.lit(0), F.col("group_n"), F.col("kept"))).alias("p0")))

    shares = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "block", "blocks", F.pmod(F.xxhash64("term"), "shards").alias("shard"),
        _share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"), _share(F.col("all_n"), F.col("lang_n"), F.col("kept")).alias("q"))

    def on_grid(df: DataFrame) -> DataFrame:
        """One row for each pair of blocks that the row's block is in."""
        other = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return other.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")

    cell = ["lang", "low", "high", "shard"]
    known = on_grid(groups.select("lang", "source", "block", "blocks", "kept", "p0", "shards"))
    known = known.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    seen = on_grid(shares.drop("q")).drop("block")
    parts = seen.groupBy(*cell).cogroup(known.groupBy(*cell)).applyInPandas(_sum_pairs, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    over, apart = F.col("p") > F.col("q"), F.col("p") - F.col("q")
    terms = shares.filter(over).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", apart * apart, F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
