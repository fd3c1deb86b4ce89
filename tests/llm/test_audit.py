"""Merkle manifest, quality rules and divergence audit against SQL and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.llm import divergence, merkle, ngram_ratio
from casewise.llm.queries import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NAMES = ["op11_merkle_manifest", "op12_ngram_ratio", "op13_source_divergence"]
by_text = lambda row: tuple(map(repr, row))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, results, tables):
    want = tables.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r[c] for c in columns) for r in results(name)]
    assert sorted(got, key=by_text) == sorted(want.fetchall(), key=by_text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hash_tree(leaves, fan):
    proofs, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        for at in range(0, len(nodes), fan):
            run = nodes[at : at + fan]
            for k in range(len(run)):
                for i in under[at + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        under = [sum(under[at : at + fan], []) for at in range(0, len(nodes), fan)]
        nodes = [sha("".join(nodes[at : at + fan])) for at in range(0, len(nodes), fan)]
    return nodes[0], proofs


def plain_manifest(rows, fan):
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((key is not None, key or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [hash_tree([leaf for *_, leaf in sorted(groups[g])], fan) for g in names]
    root, tops = hash_tree([t[0] for t in trees], fan)
    return sorted(
        ((some and key or (0 if some else None), leaf, subroot, root, "".join(b + a for b, a in proof + top))
         for g, (subroot, proofs), top in zip(names, trees, tops) for (some, key, leaf), proof in zip(sorted(groups[g]), proofs)), key=by_text)


@pytest.mark.parametrize("fan,levels,sizes", [(3, 2, [1, 2, 3, 4, 9, 10, 81, 82, 200]), (2, 3, [1, 7, 8, 9, 33]), (3, 5, [1, 1, 1]), (4, 1, [70])])
def test_manifest_is_the_plain_tree(spark, fan, levels, sizes):
    """Trees of all shapes, a null group, null and repeated keys, over several rounds of blocks and on many partitions."""
    rows = [(i if i % 7 else i // 7 or None, f"g{g}" if g else None, sha(f"{g}/{i // 2}")) for g, n in enumerate(sizes) for i in range(n)]
    given = spark.createDataFrame(rows, "key long, grp string, leaf string").repartition(5)
    out = merkle.manifest(given, F.col("grp"), F.col("key"), F.col("leaf"), fan=fan, levels=levels)
    got = [tuple(r) for r in out.select("key", "leaf", "subroot", "root", merkle.siblings(F.col("proof"))).collect()]
    assert sorted(got, key=by_text) == plain_manifest(rows, fan)
    assert out.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_audit_edges(edge, nothing):
    rows = edge.select("doc_id", "source", "lang", "n_chars", "text").collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (*r[:4], text))))
    leaves = Counter((r.doc_id, leaf(r, r.text)) for r in rows)
    got = merkle.audit(edge).collect()
    assert Counter((r.doc_id, r.leaf) for r in got) == leaves and len({r.root for r in got}) == 1
    assert {r.subroot for r in got} == {r.root for r in got}  # one group, whose source is null
    changed = {r.doc_id for r in rows if r.text and "\n" in r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0}
    for r in got:
        assert r.verified == (r.folded_root == r.root) == (r.doc_id not in changed)
    assert merkle.audit(nothing).count() == 0 and merkle.audit(nothing).columns == merkle.audit(edge).columns


def test_a_group_is_many_tasks(spark):
    """No window holds more of a tree than a block."""
    nodes = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("place"), F.lit(1000).cast("long").alias("size"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    sizes = merkle._climb(nodes, 3, 3).groupBy("tree", "block").count().collect()
    assert len(sizes) == -(-1000 // 27) and max(r["count"] for r in sizes) == 27


def base_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (7, 1, 0), (11, 1, 1), (13, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def test_rules_on_edges(edge, nothing, labels):
    texts = sorted(((r.doc_id, *base_counts(r.text)) for r in edge.collect()), key=by_text)
    rows = ngram_ratio.judge(edge, labels).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=by_text) == texts
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed) and (r.score is None) == (r.n_words == 0)
    assert ngram_ratio.judge(nothing, labels).count() == 0 and ngram_ratio.judge(edge, labels.limit(0)).count() == len(rows)


def test_repeats_like_plain_python():
    chance = random.Random(3)
    for _ in range(300):
        text = "".join(chance.choice(["a", "b", "b ", "a ", " ", "\n", "\x85", "é#"]) for _ in range(chance.randrange(120)))
        assert (ngram_ratio.repeated_lines(text), ngram_ratio.repeated_words(text.encode().split())) == base_counts(text)[3:]


def test_ngrams_stay_in_their_text():
    """Buckets of a text don't depend on its neighbours."""
    texts = ["Ab c!!", None, "", "c!! ab", "x", "Zé--1 2"]
    data, cuts = ngram_ratio._bytes_of(texts)
    found, owner = ngram_ratio.ngram_buckets(data, cuts, 1 << 10)
    for i, t in enumerate(texts):
        alone, _ = ngram_ratio.ngram_buckets(*ngram_ratio._bytes_of([t]), 1 << 10)
        assert sorted(found[owner == i]) == sorted(alone)
        tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", t or "")
        assert len(alone) == max(0, 2 * len(tokens) - 1)


def test_verdicts(results, tables):
    """Nearly all good documents are kept that the base rules let pass, nearly all bad ones are not."""
    labels = dict(tables.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = defaultdict(list)
    for r in results("op12_ngram_ratio"):
        if r.doc_id in labels and not r.base_failed:
            kept[labels[r.doc_id]].append(r.kept)
    assert np.mean(kept[1]) >= 0.98 and np.mean(kept[0]) <= 0.1


@pytest.mark.parametrize("wide,few", [(divergence.PARTITION_FROM, divergence.TOGETHER_BELOW), (40, 3)])
def test_pointers_are_sorted(monkeypatch, wide, few):
    monkeypatch.setattr(divergence, "PARTITION_FROM", wide)
    monkeypatch.setattr(divergence, "TOGETHER_BELOW", few)
    chance = random.Random(1)
    words = ["".join(chance.choice("abé") for _ in range(chance.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 30]))) for _ in range(200)]
    words += [w + "x" for w in words[:90]] + ["a" * 8, "a" * 9, "a" * 16]
    texts = [" ".join(chance.choice(words) for _ in range(chance.randrange(60))) for _ in range(90)] + [""]
    each = [t.encode() for t in texts]
    data, cuts = np.frombuffer(b"".join(each), np.uint8), np.append(0, np.cumsum([len(e) for e in each]))
    starts, sizes = divergence.word_pointers(data, cuts)
    found = [bytes(data[a : a + n]) for a, n in zip(starts, sizes)]
    assert found == [w.encode() for t in texts for w in t.split()]
    order, begins = divergence.sort_pointers(data, starts, sizes)
    held = [found[i] for i in order]
    assert held == sorted(found) and sorted(order) == list(range(len(found)))
    assert list(begins) == [i == 0 or held[i] != held[i - 1] for i in range(len(held))]


def plain_audit(rows, least=3, top=200):
    counts, docs, groups, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        for s in sources:
            langs[lang].update({t: n for t, n in counts[lang, s].items() if t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        shares = {s: share(counts[lang, s]) for s in sources}
        whole = share(langs[lang])
        for s, p in shares.items():
            pairs = [(x, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for x, q in shares.items() if x != s]
            terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard": 3, "block": 2}])
def test_divergence_on_edges(spark, edge, nothing, sizes):
    """Also with shards and blocks of sources far smaller than the vocabulary and the sources."""
    chance = random.Random(5)
    words = ["a", "B", "b", "é", "É", "zz1zz", "\x7f", "longer_words", "ll" * 9]
    rows = [(" ".join(chance.choice(words) for _ in range(chance.randrange(12))), chance.choice(["x", None, ""]), f"s{chance.randrange(7)}") for _ in range(200)]
    rows += [(None, "x", "empty"), ("one two", "alone", "s"), ("three", "alone", "t"), ("Only", "x", None)] + [("same same", "y", "hot")] * 90
    given = spark.createDataFrame([(t, lang, s, 1) for t, lang, s in rows], "text string, lang string, source string, term int").repartition(4)
    assert sorted(map(tuple, divergence.audit(given, **sizes).collect())) == plain_audit(rows)
    if not sizes:
        got = sorted(map(tuple, divergence.audit(edge).collect()))
        assert got == plain_audit([(r.text, r.lang, r.source) for r in edge.collect()])
        assert divergence.audit(nothing).count() == 0


def test_slices_of_a_batch(monkeypatch, spark):
    """Slices smaller than a text, and a batch that doesn't begin where its buffer begins."""
    import pyarrow as pa

    texts = ["ab cd", "", "ef", "ab", "cd ab", "x" * 50]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["l"] * 6, "source": list("stsstt")}).slice(1)
    whole = Counter()
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        got = Counter()
        for part in divergence.count_words([batch]):
            for r in part.to_pylist():
                got[r["source"], r["term"], "n"] += r["n"]
                got[r["source"], r["term"], "docs"] += r["docs"]
        whole = whole or got
        assert got == whole and got["t", "ab", "docs"] == 1 and got["s", "ab", "n"] == 1 and got["t", "cd", "n"] == 1


def test_every_trusted_document_counts(spark):
    """No bound on the trusted target: far apart in hash or not, all good documents are in it, repeated labels once."""
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    trusted = ngram_ratio.trusted_ids(labels.union(labels))
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'word' AS text").union(spark.createDataFrame([(3, "two words"), (None, "x")], "doc_id long, text string"))
    raw, target = ngram_ratio.count_buckets(docs, trusted.withColumn("doc_id", F.col("doc_id").cast("int")), 1 << 10)
    assert (raw.sum(), target.sum()) == (30_004, 25_003)
