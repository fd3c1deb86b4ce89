"""Similarity join on five-word shingles by adaptive multi-match prefixes.

Two documents link when ``100 |x ∩ y| >= 80 |x ∪ y|`` for their shingle sets. Shingles have one global order, rare ones first, by an
estimate of their document count. If x and y link, they share at least L of the first ``|.| - ceil(0.8 |.|) + L`` shingles of both; so a
document whose first shingles are common takes a longer prefix (a larger L) and asks for more matches, where that lowers the
estimated cost of its candidates. A pair needs as many matches as the smaller L of the two.

1. Documents of the same set form a class, told by a 128-bit fingerprint; a sketch of fixed size counts shingles.
2. Each class writes its prefix; shingles in no other prefix are dropped by a bitmap of fixed size before anything is shuffled.
3. A shingle that at most ``FEW`` sets have pairs these at once. A pair met so is verified if it has matches enough, supposing that what
   both have of the other shared shingles is common to them. What follows is for pairs that meet only in shingles that more sets have.
4. Stars: within such a shingle and a size band, the class leads whose prefix has the smallest share of shingles that no other prefix
   has: of a text and its edited copies, that is the text. Each class is verified against the leader it shares most with, so a group of
   thousands of near copies becomes a star of as many pairs. Classes without a link elect new leaders among themselves, as long as
   that links a good part of them; in the end they hang on a leader that they have been measured against, if it isn't too far.
5. Sets that hang on one hub meet by the rare ones of their differences from it. Hubs whose groups share enough prefix shingles are
   verified. Where the triangle inequality of the Jaccard distance leaves a link of members possible, the members are verified
   against the other hub; so are the pairs of members still apart that these distances leave possible. Every pair that may link
   is verified or already connected, so components are exact.

Nothing is collected but the sketch and bitmaps, whose sizes are fixed.

Texts without words have an empty set and link with nothing; a null id is smaller than none and never names a component that has
another id. Repeated rows are members of one class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.bounded_filter import key_filter, passes
from casewise.llm.common import cut, fresh, small_batches, write_table
from casewise.llm.components import roots
from casewise.llm.shingles import mix, shingle_sets

PERCENT = 80
SKETCH_BITS, SLICES = 20, 16
POSTING_COST, SCAN_COST, VERIFY_COST = 1.0, 1.0, 0.5  # a prefix shingle, a document met, a shingle of a candidate verified
STRAY, FEWEST = 0.05, 12
SIZE_SHIFT = 31  # sizes and matches are packed into one number
SEEN_SETS = 100_000
WANTED_BITS = 1 << 24
FEW = 4  # a shingle that no more sets have pairs them at once
BITS = 1 << 28
SPREAD = (100 + PERCENT) // (100 - PERCENT)  # sets link if they differ in no more than their sizes' sum over this
RADIUS = 0.5  # the distance up to which a set without a link hangs on a hub
LARGE_SET, LEADER_SHARE = 200, 8  # of larger sets, one shingle in so many votes for a leader
STRAY_STEPS = 1000  # a prefix's share of shingles of its own, in so many steps
LIMIT = 1 - PERCENT / 100 + 1e-9  # the distance of a link, with room for rounding
WORTH = 0.1  # leaders are elected again while so many of the pairs verified last were links
LINKED = f"100 * both >= {PERCENT} * whole"


def needed(n):
    """The least intersection that a set of n shingles can link with."""
    return (PERCENT * n + 99) // 100


def least_matches(n: int) -> int:
    """What a set of n shingles asks for at least, so that a partner's size tells something about what the partner asks for."""
    return max(1, n // FEWEST)


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order."""
    return np.array([values.sum(dtype=np.uint64), mix(values ^ np.uint64(0x5BD1E995A5A5A5A5)).sum(dtype=np.uint64)], ">u8").tobytes()


def _batch(columns, types, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _survey(batches):
    """Members (id, mark, n, set), and at the end the task's part of the sketch."""
    sketch, names = np.zeros(1 << SKETCH_BITS, np.int64), ["id", "mark", "n", "set", "slice", "counts"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    for batch in batches:
        sizes, sets = [], []
        for values in shingle_sets(batch.column("text").to_pylist()):
            sizes.append(len(values))
            sets.append(fingerprint(values))
            np.add.at(sketch, _cells(values), 1)
        empty = [None] * len(sizes)
        yield _batch([batch.column("id").to_pylist(), batch.column("mark").to_pylist(), sizes, sets, empty, empty], types, names)
    width = len(sketch) // SLICES
    for s in range(SLICES):
        part = sketch[s * width : (s + 1) * width]
        if part.any():
            yield _batch([[None], [None], [None], [None], [s], [zlib.compress(part.astype("<u4").tobytes(), 1)]], types, names)


def _add_counts(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(zlib.decompress(row["counts"]), "<u4").astype(np.int64)
            sums[row["slice"]] = sums[row["slice"]] + part if row["slice"] in sums else part
    for s, total in sums.items():
        yield _batch([[s], [zlib.compress(total.tobytes(), 1)]], (pa.int32(), pa.binary()), ["slice", "counts"])


def _cells(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def choose_prefix(values: np.ndarray, counts: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """A set's prefix in the global order and the matches it asks for. ``counts``: the sketch's counts of its values.

    Documents met in a prefix: what its shingles' cells hold beyond the noise, and ``STRAY`` for a shingle that a few may share. At most a share of
    1 / matches of the meetings can be candidates, and each costs the reading and shuffling of a whole set."""
    n = len(values)
    order = np.lexsort((values, counts))
    base, matches = n - int(needed(n)), np.arange(least_matches(n), int(needed(n)) + 1)
    met = np.cumsum(np.maximum(counts[order] - noise, 0.0) + STRAY)[base + matches - 1]
    cost = POSTING_COST * (base + matches) + met * (SCAN_COST + VERIFY_COST * n / matches)
    best = int(matches[cost.argmin()])
    return values[order[: base + best]], best


def _prefixes(sketch):
    def run(batches):
        counts = np.frombuffer(sketch.value, np.int64)
        mean = counts.mean()
        noise = mean + 3 * np.sqrt(mean)
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for values in shingle_sets(batch.column("text").to_pylist()):
                if not len(values) or (name := fingerprint(values)) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(name)
                prefix, matches = choose_prefix(values, counts[_cells(values)], noise)
                rows.append((name, len(values), matches, prefix.astype("<u8").tobytes()))
            if rows:
                yield _batch(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), ["set", "n", "matches", "prefix"])

    return run


def _postings(repeated):
    """A row per prefix shingle that may stand in another prefix too; size and matches packed into one number, and the set's place in an
    election: by size band, then by its share of shingles of its own."""
    def run(batches):
        for batch in batches:
            tokens, sets, packed, places = [], [], [], []
            for row in batch.to_pylist():
                prefix = np.frombuffer(row["prefix"], "<u8")
                kept = prefix[passes(repeated.value, prefix, BITS)]
                tokens.append(kept.view(np.int64))
                sets += [row["set"]] * len(kept)
                packed.append(np.full(len(kept), row["n"] << SIZE_SHIFT | row["matches"], np.int64))
                stray = (len(prefix) - len(kept)) * STRAY_STEPS // len(prefix)
                places.append(np.full(len(kept), int(size_band(np.int64(row["n"]))) * (STRAY_STEPS + 1) + stray, np.int32))
            if sets:
                yield _batch([np.concatenate(tokens), sets, np.concatenate(packed), np.concatenate(places)],
                             (pa.int64(), pa.binary(), pa.int64(), pa.int32()), ["token", "set", "size", "place"])

    return run


def size_band(n: np.ndarray) -> np.ndarray:
    """Sets of one band can link: their sizes differ by less than a factor of 0.8."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / PERCENT)).astype(np.int64)


def _meet(batches):
    """Postings sorted by token, place, set. Of a token that 2 to ``FEW`` sets have: every two of them whose sizes may link (set, other, asked). Of
    one that more have: its postings. Holds the last token's postings between batches while they are few, then its last one."""
    names = ["token", "set", "size", "place", "other", "asked"]
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    held, told = None, 0  # postings of the last token; how many of them have been told, for there are more than ``FEW``

    def rows(token, sets, size, place, told):
        """Postings and pairs of whole tokens; ``told``: as many first ones are known to be of a token with many."""
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.concatenate([begins, [len(token)]]))
        if told:
            count[0] = max(count[0], FEW + 1)
        count = np.repeat(count, np.diff(np.concatenate([begins, [len(token)]])))
        out = []
        many = np.flatnonzero(count > FEW)
        many = many[many >= told]
        if len(many):
            empty = pa.nulls(len(many))
            out.append(_batch([token[many], sets[many].tolist(), size[many], place[many], empty.cast(pa.binary()), empty.cast(pa.int64())], types, names))
        n, asked = size >> SIZE_SHIFT, size & ((1 << SIZE_SHIFT) - 1)
        for step in range(1, FEW):
            i = np.flatnonzero((count[:-step] <= FEW) & (token[step:] == token[:-step]))
            i = i[(100 * n[i] >= PERCENT * n[i + step]) & (100 * n[i + step] >= PERCENT * n[i])]
            if len(i):
                empty = pa.nulls(len(i))
                out.append(_batch([empty.cast(pa.int64()), sets[i].tolist(), empty.cast(pa.int64()), empty.cast(pa.int32()), sets[i + step].tolist(),
                                   np.minimum(asked[i], asked[i + step])], types, names))
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        token, size, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "size", "place"))
        sets = np.frombuffer(b"".join(batch.column("set").to_pylist()), "V16")
        if held:
            token, sets, size, place = (np.concatenate(x) for x in zip(held, (token, sets, size, place)))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])])
        token, sets, size, place = token[new], sets[new], size[new], place[new]
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield from rows(token[:last], sets[:last], size[:last], place[:last], told)
            token, sets, size, place, told = token[last:], sets[last:], size[last:], place[last:], 0
        if told or len(token) > FEW:
            yield from rows(token, sets, size, place, told)
            token, sets, size, place, told = token[-1:], sets[-1:], size[-1:], place[-1:], 1
        held = token, sets, size, place
    if held and not told:
        yield from rows(*held, 0)


def _wanted_sets(wanted):
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for values in shingle_sets(batch.column("text").to_pylist()):
                name = fingerprint(values)
                if len(values) and name not in seen and passes(wanted.value, np.frombuffer(name[:8], "<u8"), WANTED_BITS)[0]:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(name)
                    rows.append((name, values.astype("<u8").tobytes()))
            if rows:
                yield _batch(zip(*rows), (pa.binary(), pa.binary()), ["set", "values"])

    return run


def _overlaps(batches):
    for batch in batches:
        rows = []
        for a, b in zip(batch.column("values_a").to_pylist(), batch.column("values_b").to_pylist()):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            rows.append((both, len(x) + len(y) - both))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["a", "b", "both", "whole"])


def _passing(wanted):
    def run(batches):
        for batch in batches:
            starts = np.frombuffer(b"".join(x[:8] for x in batch.column("set").to_pylist()), "<u8")
            yield batch.filter(pa.array(passes(wanted.value, starts, WANTED_BITS)))

    return run


def possible_sets(read: DataFrame, names: DataFrame) -> DataFrame:
    """(set, values) of the sets in ``names``, written once."""
    wanted = key_filter(names, "set", 1, WANTED_BITS)
    sets = read.mapInArrow(_wanted_sets(wanted), "set binary, values binary").join(names, "set", "left_semi").dropDuplicates(["set"])
    out = write_table(sets)
    wanted.destroy()
    return out


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact overlaps of pairs (a, b) of classes: a, b, both, whole. Only sets that stand in a pair leave their task."""
    pairs = cut(pairs.select("a", "b"))
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(0).cast("long").alias("both"), F.lit(1).cast("long").alias("whole"))
    names = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))
    wanted = key_filter(names, "set", 1, WANTED_BITS)
    sets = sets.mapInArrow(_passing(wanted), "set binary, values binary")
    left = sets.select(F.col("set").alias("a"), F.col("values").alias("values_a"))
    right = sets.select(F.col("set").alias("b"), F.col("values").alias("values_b"))
    out = cut(pairs.join(left, "a").join(right, "b").mapInArrow(_overlaps, "a binary, b binary, both long, whole long"))
    wanted.destroy()
    return out


def _matches(packed: str):
    return F.col(packed).bitwiseAND((1 << SIZE_SHIFT) - 1)


def _fit(placed: DataFrame) -> DataFrame:
    """Names of the sets that have as many of the shingles in ``placed`` as any partner would ask for."""
    partner = F.floor(F.ceil(F.col("n") * PERCENT / 100) / FEWEST)
    return placed.groupBy("set").agg(F.count(F.lit(1)).alias("held"), F.min("asked").alias("asked"), F.min("n").alias("n")).filter(
        F.col("held") >= F.least("asked", F.greatest(partner, F.lit(1)))).select("set")


def survey(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, object]:
    """(members, broadcast sketch). A member's ``mark`` is a hash of its text, which tells rows of one key apart."""
    read = docs.select(docs[key].cast("long").alias("id"), F.xxhash64(docs[text]).alias("mark"), docs[text].alias("text"))
    found = cut(read.mapInArrow(_survey, "id long, mark long, n long, set binary, slice int, counts binary"))
    parts = found.filter("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_add_counts, "slice int, counts binary")
    sketch, width = np.zeros(1 << SKETCH_BITS, np.int64), (1 << SKETCH_BITS) // SLICES
    for row in parts.collect():  # SLICES rows of at most a fixed size
        sketch[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return found.filter("slice IS NULL").select("id", "mark", "n", "set"), docs.sparkSession.sparkContext.broadcast(sketch.tobytes())


def class_roots(docs: DataFrame, sketch, text: str) -> DataFrame:
    """(node, root) of the classes that links connect, as ``roots`` gives them."""
    read = docs.select(docs[text].alias("text"))
    prefixes = cut(read.mapInArrow(_prefixes(sketch), "set binary, n long, matches long, prefix binary"))
    sketch.destroy()
    repeated = key_filter(prefixes, "prefix", 2, BITS)
    postings = prefixes.mapInArrow(_postings(repeated), "token long, set binary, size long, place int")
    sorted_ = postings.repartition(F.col("token")).sortWithinPartitions("token", "place", "set")
    met = write_table(sorted_.mapInArrow(_meet, "token long, set binary, size long, place int, other binary, asked long"))
    repeated.destroy()
    shared = met.filter("other IS NULL").select("token", "set", "size", "place")
    pairs = _paired(met.filter("other IS NOT NULL"), shared)
    alike = cut(_fit(shared.select("set", F.shiftright("size", SIZE_SHIFT).alias("n"), _matches("size").alias("asked"))))
    sets = possible_sets(read, cut(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).unionByName(alike).distinct()))
    direct = verify(sets, pairs).filter(LINKED).select("a", "b")
    shared = write_table(shared.join(alike, "set", "left_semi"))
    return _between(sets, shared, *_stars(sets, shared), direct)


def _paired(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs (a, b) that have enough shingles in common, if what each has of those of many sets were the other's too."""
    met = pairs.groupBy(F.col("set").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.min("asked").alias("asked"))
    more = shared.groupBy("set").agg(F.count(F.lit(1)).alias("more"))
    for c in ("a", "b"):
        met = met.join(more.select(F.col("set").alias(c), F.col("more").alias("more_" + c)), c, "left")
    return cut(met.na.fill(0, ["more_a", "more_b"]).filter(F.col("met") + F.least("more_a", "more_b") >= F.col("asked")).select("a", "b"))


def _favourites(led: DataFrame) -> DataFrame:
    """Each set's leader (a, b) that it shares most prefix shingles with, if about as many as the two ask for."""
    large = F.shiftright("size", SIZE_SHIFT) >= LARGE_SET
    votes = led.filter("set <> leader").filter(~large | (F.pmod("token", F.lit(LEADER_SHARE)) == 0))
    met = votes.groupBy("set", "leader").agg(
        F.sum(F.when(large, LEADER_SHARE).otherwise(1)).alias("met"),
        F.least(F.min(_matches("size")), F.min(_matches("leader_size"))).alias("asked")).filter(F.col("met") * 2 >= F.col("asked"))
    return met.groupBy("set").agg(F.max(F.struct("met", "leader")).alias("best")).select(F.col("set").alias("a"), F.col("best.leader").alias("b"))


def _stars(sets: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, both, whole) of classes to leaders, and all pairs tried for it. Who leads whom is a guess that verification checks; what it
    misses is found afterwards."""
    banded = shared.withColumn("band", F.floor(F.col("place") / (STRAY_STEPS + 1)))
    starred = tried = led = None
    while True:
        # Whoever has no link yet elects, from those that never led.
        alone = banded
        if tried is not None:
            linked = starred.select(F.col("a").alias("set")).unionByName(starred.select(F.col("b").alias("set"))).distinct()
            alone = banded.join(linked, "set", "left_anti")
        first = alone if led is None else alone.join(led.withColumnRenamed("b", "set"), "set", "left_anti")
        first = first.groupBy("token", "band").agg(F.min(F.struct("place", "set", "size")).alias("first"))
        now = verify(sets, _favourites(alone.join(first, ["token", "band"]).select(
            "token", "set", "size", F.col("first.set").alias("leader"), F.col("first.size").alias("leader_size"))))
        starred = now.filter(LINKED) if starred is None else cut(starred.unionByName(now.filter(LINKED)))
        led = now.select("b").distinct() if led is None else cut(led.unionByName(now.select("b")).distinct())
        tried = now if tried is None else cut(tried.unionByName(now))
        pairs, found = now.agg(F.count(F.lit(1)), F.count(F.when(F.expr(LINKED), 1))).first()
        if not pairs or found < WORTH * pairs:
            return starred, tried


def _groups(starred: DataFrame, tried: DataFrame) -> DataFrame:
    """(set, hub, far, linked): sets with a link to their star's centre; and of those without any link, those that have been measured against a hub
    not too far from them. A class that leads is a centre itself, and its own link stays a link."""
    centres = starred.select(F.col("b").alias("set")).distinct()
    far = (1 - F.col("both") / F.col("whole")).alias("far")
    rays = starred.join(centres.withColumnRenamed("set", "a"), "a", "left_anti").select(F.col("a").alias("set"), F.col("b").alias("hub"), far)
    rays = rays.groupBy("set").agg(F.min(F.struct("far", "hub")).alias("best")).select("set", "best.hub", "best.far", F.lit(True).alias("linked"))
    known = centres.unionByName(starred.select(F.col("a").alias("set"))).distinct()
    near = tried.select(F.col("a").alias("set"), F.col("b").alias("hub"), far).filter(F.col("far") <= RADIUS).join(known, "set", "left_anti")
    # No set that others have been measured against hangs on one itself.
    near = near.join(near.select(F.col("hub").alias("set")).distinct(), "set", "left_anti")
    near = near.groupBy("set").agg(F.min(F.struct("far", "hub")).alias("best")).select("set", "best.hub", "best.far", F.lit(False).alias("linked"))
    return cut(rays.unionByName(near))


def _differences(batches):
    """A row for each shingle in which a set and its hub differ, with the set's size and debt."""
    names = ["token", "set", "hub", "linked", "n", "debt", "differences"]
    types = (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        rows, tokens = [], []
        for row in batch.to_pylist():
            x, y = np.frombuffer(row["values"], "<u8"), np.frombuffer(row["hub_values"], "<u8")
            both = np.setxor1d(x, y, assume_unique=True)
            rows.append((row["set"], row["hub"], row["linked"], len(x), SPREAD * len(both) - len(x), len(both)))
            tokens.append(both.view(np.int64))
        if rows:
            take = pa.array(np.repeat(np.arange(len(rows)), [len(t) for t in tokens]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *(pa.array(c, t).take(take) for c, t in zip(zip(*rows), types))], names)


def _within(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between sets of one hub of which one at least has no link with the hub.

    x and y share all of the hub but what they differ in from it, so they link exactly if ``2 * SPREAD`` times the differences that they share are as many as their
    debts together: ``SPREAD`` times the differences less the size of each. A set without a link with the hub owes more than the hub's size, any other set at least
    minus that: none links with it without a shared difference. So it is enough to join the first differences of each, rare ones first."""
    if groups.filter("NOT linked").isEmpty():
        return groups.select(F.col("set").alias("a"), F.col("hub").alias("b")).limit(0)
    busy = groups.join(groups.filter("NOT linked").select("hub").distinct(), "hub", "left_semi")
    read = busy.join(sets, "set").join(sets.select(F.col("set").alias("hub"), F.col("values").alias("hub_values")), "hub")
    apart = write_table(read.select("set", "hub", "linked", "values", "hub_values").mapInArrow(
        _differences, "token long, set binary, hub binary, linked boolean, n long, debt long, differences long"))
    least = apart.groupBy("hub").agg(F.min(F.when(F.col("linked"), F.col("debt"))).alias("linked_debt"), F.min(F.when(~F.col("linked"), F.col("debt"))).alias("loose_debt"))
    turns = apart.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("hub", "token"))).withColumn(
        "turn", F.row_number().over(Window.partitionBy("set").orderBy("held", "token"))).filter("held > 1").join(least, "hub")
    # What is shared with a linked set and with a loose one at least.
    first = lambda debt: F.col("differences") - F.greatest(F.lit(1), F.ceil((F.col("debt") + F.col(debt)) / (2 * SPREAD))) + 1
    parts = write_table(turns.withColumns({"to_linked": ~F.col("linked") & (F.col("turn") <= first("linked_debt")), "to_loose": F.col("turn") <= first("loose_debt")}).filter(
        "to_linked OR to_loose").select("hub", "token", "set", "n", "linked", F.coalesce("to_linked", F.lit(False)).alias("to_linked"), "to_loose"))
    x = parts.filter("NOT linked").select("hub", "token", F.col("set").alias("a"), F.col("n").alias("n_a"), "to_linked", F.col("to_loose").alias("loose_a"))
    y = parts.filter("to_loose").select("hub", "token", F.col("set").alias("b"), F.col("n").alias("n_b"), "linked")
    fits = (F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (F.col("n_b") * 100 >= F.col("n_a") * PERCENT)
    either = F.when(F.col("linked"), F.col("to_linked")).otherwise(F.col("loose_a") & (F.col("a") < F.col("b")))
    return verify(sets, x.join(y, ["hub", "token"]).filter(fits & either).select("a", "b").distinct()).filter(LINKED).select("a", "b")


def _between(sets, shared, starred, tried, direct):
    """Roots by all links so far and those found within and between the groups of hubs."""
    groups = _groups(starred, tried)
    top = roots(starred.select("a", "b").unionByName(direct).unionByName(_within(sets, groups)), "a", "b")
    placed = shared.select("token", "set", F.shiftright("size", SIZE_SHIFT).alias("n"), _matches("size").alias("asked"))
    placed = placed.join(_rooted(shared.select("set").distinct(), top).join(groups.select("set", "hub"), "set", "left"), "set").withColumn("hub", F.coalesce("hub", "set"))
    # Only shingles that sets of several groups have; and of those only sets that have as many as any partner would ask for.
    ends = Window.partitionBy("token")
    several = (F.min("root").over(ends) != F.max("root").over(ends)) & (F.min("hub").over(ends) != F.max("hub").over(ends))
    mixed = write_table(placed.repartition(F.col("token")).withColumn("several", several).filter("several").drop("several"))
    placed = cut(mixed.join(_fit(mixed), "set", "left_semi").groupBy("token", "hub").agg(
        F.min("asked").alias("asked"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("root"), F.max("root").alias("top")))
    x = placed.select("token", *(F.col(c).alias(c + "_a") for c in ("hub", "root", "top", "asked", "low", "high")))
    y = placed.select("token", *(F.col(c).alias(c + "_b") for c in ("hub", "root", "top", "asked", "low", "high")))
    fits = (F.col("high_a") * 100 >= F.col("low_b") * PERCENT) & (F.col("high_b") * 100 >= F.col("low_a") * PERCENT)
    differ = (F.col("root_a") != F.col("root_b")) | (F.col("top_a") != F.col("top_b")) | (F.col("root_a") != F.col("top_a"))
    pairs = x.join(y, "token").filter((F.col("hub_a") < F.col("hub_b")) & differ & fits)
    pairs = pairs.groupBy("hub_a", "hub_b").agg(
        F.count(F.lit(1)).alias("met"), F.least(F.min("asked_a"), F.min("asked_b")).alias("asked")).filter("met >= asked")
    measured = verify(sets, pairs.select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b")))
    top = roots(measured.filter(LINKED), "a", "b", top)

    # Sets of two groups can link only if their hubs are near enough for it. A hub that others hang on without a link is no member of theirs.
    members = groups.select("hub", "set", "far", "linked")
    hubs = measured.select(F.col("a").alias("hub")).unionByName(measured.select(F.col("b").alias("hub"))).distinct()
    members = cut(members.unionByName(hubs.select("hub", F.col("hub").alias("set"), F.lit(0.0).alias("far"), F.lit(True).alias("linked"))).join(
        hubs, "hub", "left_semi"))
    reach = members.groupBy("hub").agg(F.max("far").alias("far"), F.max(F.when(~F.col("linked"), F.col("far"))).alias("loose"))
    apart = measured.withColumn("gap", 1 - F.col("both") / F.col("whole")).select("a", "b", "gap")
    turned = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    turned = turned.join(reach.select(F.col("hub").alias("b"), "far", "loose"), "b").withColumnsRenamed({"far": "far_b", "loose": "loose_b"})
    tops = _rooted(hubs.withColumnRenamed("hub", "set"), top)
    for c in ("a", "b"):
        turned = turned.join(tops.select(F.col("set").alias(c), F.col("root").alias("root_" + c)), c)
    # Of two connected hubs, only those hang on them without a link may be apart.
    turned = turned.withColumn("one", F.col("root_a") == F.col("root_b")).drop("root_a", "root_b")
    crossing = members.select(F.col("hub").alias("a"), F.col("set").alias("x"), F.col("far").alias("far_x"), "linked").join(turned, "a").filter(
        F.col("gap") <= F.col("far_x") + F.when(F.col("one") & F.col("linked"), F.col("loose_b")).otherwise(F.col("far_b")) + LIMIT)
    crossing = cut(crossing.filter("x <> a").select("a", "b", "x", "far_x", "far_b"))
    if crossing.isEmpty():
        return top

    # Members against the other group's hub.
    away = verify(sets, crossing.select(F.col("x").alias("a"), "b").distinct())
    top = roots(away.filter(LINKED), "a", "b", top)

    # Pairs of members that are still apart.
    away = away.select(F.col("a").alias("x"), "b", (1 - F.col("both") / F.col("whole")).alias("off"))
    near = crossing.join(away, ["x", "b"]).filter(F.col("off") <= F.col("far_b") + LIMIT)
    near = cut(near.join(_rooted(near.select(F.col("x").alias("set")).distinct(), top).withColumnRenamed("set", "x"), "x"))
    left = near.select("a", "b", "x", "far_x", "off", F.col("root").alias("root_x"))
    right = near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("x").alias("y"), F.col("far_x").alias("far_y"), F.col("off").alias("off_y"), F.col("root").alias("root_y"))
    both = left.filter("a < b").join(right, ["a", "b"]).filter(
        (F.col("off") <= F.col("far_y") + LIMIT) & (F.col("off_y") <= F.col("far_x") + LIMIT) & (F.col("root_x") != F.col("root_y")))
    found = verify(sets, both.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).filter(LINKED)
    return roots(found, "a", "b", top)


def _rooted(names: DataFrame, top: DataFrame) -> DataFrame:
    """(set, root) of the sets in ``names``; ``top``: (node, root) of those that aren't roots themselves."""
    return names.join(top.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _linked(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, mark, n and component_id of every row."""
    with small_batches(docs.sparkSession):  # all that goes through Python is written or collected in here
        members, sketch = survey(docs, text, key)
        top = class_roots(docs, sketch, text)
    some = _rooted(members.filter("n > 0"), top)
    least = some.groupBy("root").agg(F.min("id").alias("component_id"))
    out = some.join(least, "root").select("id", "mark", "n", "component_id")
    return out.unionByName(members.filter("n = 0").select("id", "mark", "n", F.col("id").alias("component_id")))


def link_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id`` (the smallest key reachable by links)."""
    return _linked(docs, text, key).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest key; documents without a key stay."""
    number, mark = fresh(docs, "_number"), fresh(docs, "_mark")
    drop = _linked(docs, text, key).filter(F.col("component_id") < F.col("id")).select(F.col("id").alias(number), F.col("mark").alias(mark))
    return docs.withColumn(mark, F.xxhash64(F.col(text))).withColumn(number, F.col(key).cast("long")).join(
        drop, [number, mark], "left_anti").select(*docs.columns)
