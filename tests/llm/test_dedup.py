"""Exact dedup, near-duplicate join and repeated passages against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from casewise.llm import bounded_filter, common, exact_dedup, ngram_join, passages, shingles
from casewise.llm.components import roots
from casewise.llm.queries import ORACLES
from casewise.llm.shingles import combine, shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_matches_sql(results, tables):
    got = sorted(map(tuple, results("op2_exact_dedup")))
    assert got == sorted(tables.execute(ORACLES["op2_exact_dedup"]).fetchall())


@pytest.mark.parametrize("bits", [exact_dedup.FILTER_BITS, 8 * exact_dedup.SLICES * exact_dedup.WAYS])
def test_exact_edges(edge, bits):
    """A filter far too small gives the same groups."""
    rows = edge.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(lowered(r.text).encode()).hexdigest()].append(r.doc_id)
    got = exact_dedup.duplicate_groups(edge, filter_bits=bits).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_keep_one(edge, nothing):
    out = exact_dedup.keep_one(edge)
    assert out.columns == edge.columns
    assert len({lowered(r.text) for r in out.collect()}) == out.count() == len({lowered(r.text) for r in edge.collect()})
    assert exact_dedup.keep_one(nothing).count() == 0 and exact_dedup.duplicate_groups(nothing).count() == 0


def components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lowered(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    met = defaultdict(int)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                met[ids[b], ids[a]] += 1
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in met.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_matches_brute_force(results, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in results("op1_ngram_join")} == components(texts.items())


def chains():
    """Groups of copies at all distances from their source, chains of small steps, and texts that share a frequent passage."""
    rng, rows = random.Random(5), []
    common = [f"c{i}" for i in range(40)]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice([12, 60, 150]))]
        now = list(base)
        for _ in range(25):
            source = now if g % 2 else list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                source[rng.randrange(len(source))] = f"n{rng.random()}"
            now = list(source)
            rows.append(" ".join(source + (common if g == 3 else [])))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("partitions", [1, 7])
def test_near_chains(spark, partitions):
    rows = chains()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()}
    assert got == components(rows)


def counted(monkeypatch):
    """The numbers of pairs that ``ngram_join`` verifies, call by call."""
    sizes, verify = [], ngram_join.verify

    def count(sets, pairs):
        sizes.append(pairs.count())
        return verify(sets, pairs)

    monkeypatch.setattr(ngram_join, "verify", count)
    return sizes


def test_near_group_with_loose_copies(spark, monkeypatch):
    """Copies beyond the threshold around one source, some of which link with each other: found without a pair for each two, in proportion to the copies."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        return words

    rows = [base, *(edited(base, k) for _ in range(120) for k in (1, 6))]
    rows = [" ".join(r) for r in [*rows, *(edited(words, 1) for words in rows[2:60:2])]]
    values = [np.unique(combine(*word_hashes([r])[:2])[0]) for r in rows]
    names = [ngram_join.fingerprint(v) for v in values]

    def far(i, j):
        both = len(np.intersect1d(values[i], values[j]))
        return 1 - both / (len(values[i]) + len(values[j]) - both)

    sets = spark.createDataFrame([(n, v.tobytes()) for n, v in zip(names, values)], "set binary, values binary")
    groups = spark.createDataFrame([(names[i], names[0], far(i, 0), far(i, 0) <= 0.2) for i in range(1, len(rows))], "set binary, hub binary, far double, linked boolean")
    sizes, place = counted(monkeypatch), {n: i for i, n in enumerate(names)}
    got = {tuple(sorted((place[bytes(r.a)], place[bytes(r.b)]))) for r in ngram_join._within(sets, groups).collect()}
    loose = [i for i in range(1, len(rows)) if far(i, 0) > 0.2]
    assert len(loose) >= 120 and got == {tuple(sorted((i, j))) for i in loose for j in range(1, len(rows)) if i != j and far(i, j) <= 0.2} and len(got) >= 25
    assert sizes[0] <= 5 * len(rows)


def test_shingles_that_few_have_by_chance(spark, monkeypatch):
    """Texts of a small vocabulary share shingles by chance: no such pair is verified, and their postings go no further."""
    rng = random.Random(12)
    rows = [" ".join(str(rng.randrange(9)) for _ in range(160)) for _ in range(300)]
    rows += [r.replace(" 3 ", " x ", 1) for r in rows[:20]]
    rows, held, fit = list(enumerate(rows)), [], ngram_join._fit
    monkeypatch.setattr(ngram_join, "_fit", lambda placed: held.append(placed.count()) or fit(placed))
    sizes = counted(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()} == components(rows)
    assert sum(sizes) <= 4 * 20 and max(held) <= 100


def test_meetings_across_batches():
    """Batches cut tokens anywhere: few sets make pairs, many make postings, repeated rows count once."""
    import pyarrow as pa

    rng, rows = random.Random(13), []
    for token in range(60):
        for i in rng.sample(range(40), rng.choice([1, 1, 2, 3, 4, 5, 9, 30])):
            rows += [(token, i.to_bytes(16, "big"), (50 + i % 30) << ngram_join.SIZE_SHIFT | 1 + i % 5, i // 8)] * rng.choice([1, 1, 3])
    rows.sort(key=lambda r: (r[0], r[3], r[1]))
    by = defaultdict(dict)
    for token, name, size, place in rows:
        by[token][name] = size, place
    pairs, postings = [], []
    for token, sets in by.items():
        if len(sets) > ngram_join.FEW:
            postings += [(token, n, *v) for n, v in sets.items()]
        names = list(sets) if len(sets) <= ngram_join.FEW else []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                (x, p), (y, q) = (divmod(sets[n][0], 1 << ngram_join.SIZE_SHIFT) for n in (a, b))
                if 100 * x >= 80 * y and 100 * y >= 80 * x:
                    pairs.append((a, b, min(p, q)))
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32()]
    for width in (1, 2, 7, 100, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + width]), types)], ["token", "set", "size", "place"]) for i in range(0, len(rows), width)]
        out = [r for b in ngram_join._meet(batches) for r in b.to_pylist()]
        assert sorted((r["set"], r["other"], r["asked"]) for r in out if r["other"]) == sorted(pairs)
        assert sorted((r["token"], r["set"], r["size"], r["place"]) for r in out if not r["other"]) == sorted(postings)


def test_near_edges(edge, nothing):
    got = ngram_join.link_documents(edge).collect()
    assert len(got) == edge.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[8] == by[9] == {7} and by[1] == {1} and by[2] == {2} and by[5] == by[6] == {4} and by[17] == {16} and by[18] == {18}
    kept = ngram_join.keep_first(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and 9 not in ids and 7 in ids and ids.count(18) == 2
    assert ngram_join.link_documents(nothing).count() == 0


def test_prefix_is_enough():
    """Two linked sets share as many prefix members as the smaller of what they ask for."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        cost = rng.integers(1, 400, 1 << ngram_join.SKETCH_BITS)
        other = np.unique(np.concatenate([base[rng.random(n) > 0.1], rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64)]))
        x = np.unique(base)
        both = len(np.intersect1d(x, other))
        if not len(other) or 100 * both < 80 * (len(x) + len(other) - both):
            continue
        (p, a), (q, b) = (ngram_join.choose_prefix(v, cost[ngram_join._cells(v)], 100.0) for v in (x, other))
        assert len(np.intersect1d(p, q)) >= min(a, b)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 440)]
    top = {i: i for pair in links for i in pair}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: find(i) for i in top if find(i) != i}


def test_components_grow(spark):
    """Links added to known components: the same roots as from all links at once; where they connect nothing new, no star is drawn again."""
    rng = random.Random(21)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i + 1, i) for i in range(300, 330)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    told = lambda top: {r.node: r.root for r in top.collect()}
    known, whole = roots(frame(links[::2]), "a", "b"), told(roots(frame(links), "a", "b"))
    assert told(roots(frame(links[1::2]), "a", "b", known)) == whole
    known = roots(frame(links), "a", "b")
    assert roots(frame(links[:50]), "a", "b", known) is known and told(known) == whole


def test_few_jobs_for_a_star(spark):
    """What hangs on one node already needs no round: every job's plan takes the driver's memory."""
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    links, before = spark.createDataFrame([(0, i) for i in range(1, 40)], "a long, b long"), jobs()
    assert {(r.node, r.root) for r in roots(links, "a", "b").collect()} == {(i, 0) for i in range(1, 40)}
    assert jobs() - before <= 10


def test_bitmap_to_the_driver(spark, monkeypatch):
    """Bitmaps travel compressed, so that one with few cells takes little of the driver's memory."""
    frame = type(spark.range(0))
    collect, sizes = frame.collect, []

    def seen(self):
        rows = collect(self)
        sizes.extend(len(r["bitmap"]) for r in rows if "bitmap" in self.columns)
        return rows

    monkeypatch.setattr(frame, "collect", seen)
    keys = np.random.default_rng(4).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    found = bounded_filter.key_filter(spark.createDataFrame([(k.tobytes(),) for k in (keys, keys[:2500])], "key binary"), "key", 2)
    assert bounded_filter.passes(found.value, keys[:2500]).all() and bounded_filter.passes(found.value, keys[2500:]).sum() <= 2
    assert sum(sizes) <= 200_000


def test_wide_rows_go_to_python_in_small_batches(spark):
    """Whatever rows weigh, a batch has a few MB: the JVM and the Python workers hold several at once."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])

    wide, before = spark.range(0, 600, 1, 1).selectExpr("repeat('x', 20000) AS text"), spark.conf.get(common.ARROW_BYTES)
    with common.small_batches(spark):
        found = wide.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 600 and max(r["size"] for r in found) <= 1.1 * common.BATCH_BYTES
    assert spark.conf.get(common.ARROW_BYTES) == before


def test_near_runs_in_small_batches(spark, monkeypatch):
    """All of the join that goes through Python runs while batches are bounded; the session's own setting is back afterwards."""
    frame, seen, before = type(spark.range(0)), [], spark.conf.get(common.ARROW_BYTES)
    for name in ("checkpoint", "collect", "mapInArrow"):
        def watched(self, *a, method=getattr(frame, name), **b):
            seen.append(spark.conf.get(common.ARROW_BYTES))
            return method(self, *a, **b)

        monkeypatch.setattr(frame, name, watched)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "others")], "doc_id long, text string")
    out = ngram_join.link_documents(docs)
    assert seen and set(seen) == {str(common.BATCH_BYTES)} and spark.conf.get(common.ARROW_BYTES) == before
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_sets_take_little_memory(monkeypatch):
    """A worker keeps what it has once taken; many texts at a time took more than 50 MB."""
    monkeypatch.setattr(shingles, "_powers", {})
    texts = [" ".join(f"w{i + j}" for j in range(400)) for i in range(2000)]
    tracemalloc.start()
    n = sum(len(values) for values in shingle_sets(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * 396 and most < 40e6


def test_gaps_of_cells():
    rng = np.random.default_rng(8)
    for cells in ([], [0], [65534], [65535], [65536], [0, 65535, 131070, 131071, 4_000_000], np.unique(rng.integers(0, 1 << 22, 16_000)), np.unique(rng.integers(0, 1 << 22, 9))):
        cells = np.asarray(cells, np.int64)
        packed = bounded_filter.pack_gaps(cells)
        assert bounded_filter.unpack_gaps(packed).tolist() == cells.tolist()
        assert len(cells) < 1000 or len(packed) < 2.1 * len(cells)


def test_shingles_follow_words():
    texts = ["A b  c\td e f", None, "", "x y", "a B C d e F", "😀 é a b c d"]
    hashes, owner, _, _ = word_hashes(texts)
    values, at = combine(hashes, owner)
    sets = [set(values[owner[at] == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [2, 0, 0, 1, 2, 2] and sets[0] == sets[4]


def test_compact_windows():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    cuts = np.array([0, 31, 31, 90])
    found = list(zip(*(x.tolist() for x in passages.compact_windows(values, cuts[:-1], cuts[1:], 7))))
    for a, b in ((0, 31), (31, 90)):
        for i in range(a, b):
            for j in range(i + 7, b + 1):
                c = i + int(values[i:j].argmin())
                assert sum(first <= i and j <= stop and at == c for first, at, stop in found) == 1


def repeats(rows, least=51):
    where, covered = defaultdict(list), defaultdict(set)
    for i, t in rows:
        w = WORD.findall(lowered(t))
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].append((i, k))
    for at in where.values():
        if len({i for i, _ in at}) > 1:
            for i, k in at:
                covered[i].update(range(k, k + least))
    return covered


def test_passages_hold_all_exact_repeats(results, texts):
    got = defaultdict(set)
    for r in results("op9_repeated_passages"):
        assert r.n_words >= passages.WORDS_LEAST and r.other_id != r.doc_id
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    covered = repeats(texts.items())
    assert covered and all(places <= got[i] for i, places in covered.items())
    # Whatever else is reported shares most of its shingles with the text it names.
    for r in results("op9_repeated_passages"):
        w, o = WORD.findall(lowered(texts[r.doc_id])), WORD.findall(lowered(texts[r.other_id]))
        part = {tuple(w[k : k + 5]) for k in range(r.first_word, r.first_word + r.n_words - 4)}
        assert len(part & {tuple(o[k : k + 5]) for k in range(len(o) - 4)}) >= 20


def test_passage_edges(edge, nothing):
    got = {(r.doc_id, r.first_word, r.n_words, r.other_id) for r in passages.repeated_passages(edge).collect()}
    assert {(10, 120, 70, 11), (11, 0, 70, 10), (7, 0, 200, 8), (8, 0, 200, 7)} <= got
    assert {g[0] for g in got} == {7, 8, 9, 10, 11}
    assert passages.repeated_passages(nothing).count() == 0


def test_hot_passage(spark):
    """A third of all rows hold one passage: each is reported, with a pair for each and not for each two."""
    hot = " ".join(f"h{i}" for i in range(55))
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(60)) + (" " + hot if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.repeated_passages(docs).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(300) if i % 3 == 0]
    assert passages.class_passages(docs.select("text")).count() == 2 * 99


def test_passages_of_two_frequent_lines(spark):
    """Passages of two frequent lines, each of which also stands alone with other neighbours: no leader holds the whole, yet all are found."""
    rng, rows = random.Random(4), []

    def fill(n):
        return " ".join(f"u{rng.random()}" for _ in range(n))

    for g in range(30):
        one, two = (" ".join(f"g{g}{side}{k}" for k in range(26)) for side in "lr")
        texts = [fill(60) + " " + line + " " + fill(60) for line in (one, two) * 6]
        texts += [fill(60) + " " + one + " " + two + " " + fill(60) for _ in range(2)]
        rows += texts
    rows = list(enumerate(rows))
    got = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    covered = repeats(rows, 50)
    assert len(covered) == 60 and all(places <= got[i] for i, places in covered.items())


def test_runs_follow_shingles():
    rng = np.random.default_rng(2)
    line = rng.integers(0, 1 << 63, 7).astype(np.uint64)
    for values in (rng.integers(0, 1 << 63, 200).astype(np.uint64), np.tile(line, 20)):
        cuts = np.array([0, 30, 30, len(values)])
        _, low, high, _ = passages.anchored(values, cuts)
        places = sorted(i for a, b in zip(low.tolist(), high.tolist()) for i in range(a, b + 1))
        assert places == list(range(30, len(values) - passages.LEAST + 1))
        hashes = passages.run_hashes(values).tolist()
        runs = [tuple(values[i : i + passages.LEAST].tolist()) for i in range(len(hashes))]
        assert len(set(zip(runs, hashes))) == len(set(runs)) == len(set(hashes))


@pytest.mark.parametrize("phrase", [(28, 33), (0, 12), (48, 60), (20, 40)])
def test_phrases_that_stand_elsewhere(phrase):
    """A phrase of the passage that also stands far before or after it in the other text doesn't cut the passage in two."""
    rng = np.random.default_rng(6)
    p, q, between, much = (rng.integers(0, 1 << 62, n) for n in (60, 60, 40, 5000))

    def shingles(words):
        return combine(words.astype(np.uint64), np.zeros(len(words), np.int64))[0]

    part = p[slice(*phrase)]
    x = shingles(np.concatenate([p, q]))
    for other in (np.concatenate([part, much, p, between, q]), np.concatenate([p, between, q, much, part])):
        found = passages.shared_passages(x, shingles(other), [(0, len(x))])
        covered = {i for a, b, _, _ in found for i in range(a, b)}
        assert covered >= {*range(56), *range(60, 116)}


def test_texts_are_read_five_times(spark, monkeypatch):
    """Members and windows' keys, windows, texts of pairs, runs' cells, packs: no further pass, for the anchors' keys come with the windows'."""
    rng = random.Random(31)
    line = " ".join(f"l{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(80)) + " " + line) for i in range(6)]
    frame = type(spark.range(0))
    run, passed = frame.mapInArrow, []
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a: passed.append(f) or run(self, f, *a) if "text" in self.columns else run(self, f, *a))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(6)) and all(r.n_words >= 60 for r in got) and len(passed) == 5


def test_fingerprints_of_chunks():
    """All texts of a chunk at once, as one by one; the halves have the names' order."""
    rng = np.random.default_rng(17)
    values, cuts = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2), np.array([0, 0, 7, 300, 300, 899, 900])
    names = passages.fingerprints(values, cuts)
    for name, a, b in zip(names, cuts[:-1], cuts[1:]):
        turn = np.arange(1, b - a + 1, dtype=np.uint64)
        assert name.tolist() == [int(passages.mix(values[a:b] + turn * np.uint64(k)).sum(dtype=np.uint64)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    assert passages._names(names).to_pylist() == [n.tobytes() for n in names]
    order = rng.integers(0, 1 << 63, (50, 2), dtype=np.uint64) * np.uint64(2)
    assert np.argsort(passages._halves(order.astype(">u8"))).tolist() == sorted(range(50), key=lambda i: order[i].astype(">u8").tobytes())


def test_recall_of_near_passages(spark):
    """Planted near copies of 51 words at 0.81 to 0.83, with one word changed or put in anywhere but at the edges: all but a few are found."""
    rng, rows = random.Random(9), []

    def fill(n):
        return [f"u{rng.random()}" for _ in range(n)]

    def jaccard(p, q):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (p, q))
        return len(a & b) / len(a | b)

    for n in range(400):
        p = fill(51)
        k = rng.randrange(6, 45)
        q = p[:k] + fill(1) + p[k + n % 2 :]
        assert jaccard(p, q) >= passages.PERCENT / 100
        rows += [" ".join(fill(60) + w + fill(60)) for w in (p, q)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in passages.repeated_passages(docs).collect() if r.first_word <= 62 and r.first_word + r.n_words >= 109 and r.other_id == r.doc_id ^ 1}
    assert len(got) >= 0.985 * len(rows)
