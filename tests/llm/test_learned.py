"""Language identification, quality rules, private data, top-k search and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.llm import langid, pii, quality, vafile
from casewise.llm.queries import ORACLES


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_gradients():
    w = {k: v.astype(np.float64) for k, v in langid.new_weights(3, 3).items()}
    rng = np.random.default_rng(1)
    x, sizes, y = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([6, 6, 4, 2]), np.array([0, 1, 2, 1])
    grads = langid.gradients(w, x, sizes, y)[1]
    for k in w:
        for _ in range(5):
            i = tuple(int(rng.integers(0, 5 if k[1:] == "E" and d else n)) for d, n in enumerate(w[k].shape))
            old, ends = w[k][i], []
            for e in (1e-5, -1e-5):
                w[k][i] = old + e
                ends.append(langid.gradients(w, x, sizes, y)[0])
            w[k][i] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][i]) < 1e-7


def test_positions_match_one_at_a_time():
    """Windows side by side give what each window gives alone."""
    w = langid.new_weights(3)
    texts = [b"abc" * 150, b"", b"x", "é".encode() * 300]
    got = langid.position_sums(w, texts)
    for text, sums in zip(texts, got):
        alone = sum((langid.position_sums(w, [text[i : i + langid.WINDOW]])[0] for i in range(0, len(text), langid.WINDOW)), np.zeros(3))
        assert np.allclose(alone, sums, atol=1e-3) and abs(sums.sum() - len(text)) < 1e-2


def test_language_query(results, tables):
    lang = dict(tables.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = results("op3_language_id")
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean(tested) > 0.9


def test_language_edges(edge, nothing):
    got = langid.identify(edge).collect()
    assert len(got) == edge.count() and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 13))
    assert {r.lang_pred for r in got} <= {"en", "und"} and langid.identify(nothing).count() == 0
    out = langid.predict(edge, ["en"], langid.new_weights(1))
    assert out.columns == [*edge.columns, "lang_pred", "_score"]
    assert {r.lang_pred for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_query(results, tables):
    label = dict(tables.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = results("op10_quality_rules")
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]) > 0.9


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(7, 1, "x"), (12, 0, "x"), (None, 1, "x"), (9, None, "x"), (8, 5, "x"), (7, 1, "x")], "doc_id long, quality int, text string")
    model = quality.fit(edge, labels)
    scored, name = quality.score(edge, model)
    assert name == "_score" and scored.columns == [*edge.columns, "_score"] and scored.count() == edge.count()
    assert quality.keep_good(edge, labels).columns == edge.columns
    empty, name = quality.score(edge, quality.fit(edge, labels.filter("false")))
    assert {r[name] for r in empty.collect()} == {0.5}
    assert quality.keep_good(nothing, labels).count() == 0


def test_compiled_rules_match_model(spark, edge):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    model = quality.learn(x, ((x[:, 2] > 0.6) & (x[:, 5] < 0.5)).astype(float))
    assert model.rules and ((model.margin(x) > 0) == ((x[:, 2] > 0.6) & (x[:, 5] < 0.5))).mean() > 0.95
    texts = [r.text or "" for r in edge.orderBy("doc_id", "text").collect()]
    scored, name = quality.score(edge, model)
    got = [r[name] for r in scored.orderBy("doc_id", "text").collect()]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-model.margin(quality.measure(texts))))))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def told(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check_private(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("term:")) == told(want)


def test_private_query(results, texts):
    check_private(results("op8_private_data"), texts)


def test_private_on_random_texts(spark):
    import random

    rng = random.Random(4)
    bits = ["a", "b1", "@", ".", ".", "-", " ", "+", "(", ")", "1", "2", "255", "256", "0010", "4111111111111111", "4111 1111 1111 1111", "x_y", "é", "😀",
            "a@b.c", "1.2.3.4", "+1 (736) 555-2678", "\n", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "9 " * 20_000, "a" * 50_000 + "@", "1." * 20_000, "a@b." * 2000, "+1" + " " * 30_000]
    check_private(pii.private_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), dict(enumerate(texts)))


def test_disclosing_terms(spark):
    """A name that only stands by one address is removed with it, one that mostly does is generalised, others and clean texts stay."""
    rows = [(i, f"write to Zorblat or Quibble and the team at z@example.com number x{i}y today") for i in range(10)]
    rows += [(100 + i, f"the team and number today {'Quibble' if i < 3 else 'other'} text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    # "write", "to", "or" and "at" stand nowhere else either.
    assert out[3] == "    [TERM] and the team  [EMAIL] number x3y today" and all(out[i] == t for i, t in rows if i >= 100)
    spans = {r.doc_id: r.spans for r in pii.private_spans(docs).collect()}
    assert "term:9:16" in spans[3] and "term:20:27" in spans[3] and spans[120] == ""


def test_disclosing_terms_far_away(spark):
    """A name at the head that gives away an address at the foot is found at every place, however far from it."""
    far = "the team and number today " * 40
    rows = [(i, f"Zorblat x{i}y {far} z@example.com {far} Zorblat") for i in range(10)] + [(100 + i, f"the team and number today x{i}y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zorblat" not in out[i] and "[EMAIL]" in out[i] and far.strip() in out[i] for i in range(10))
    spans = {r.doc_id: r.spans for r in pii.private_spans(docs).collect()}
    assert spans[3].count("term:") == 2 and spans[120] == ""


def term_spans(texts):
    """(doc, start, stop) of every disclosing term, by counting documents one by one."""
    n = len(texts)
    terms = {i: {t.lower() for t in re.findall(r"\w+", x)} for i, x in texts.items()}
    held = {}
    for i, x in texts.items():
        values = {(k, re.sub("[^0-9]", "", x[a:b]) if k > 1 else x[a:b].lower()) for a, k, b in base(x)}
        held[i] = {(v, (v[0], "class", [v[1].split("@")[-1], ".".join(v[1].split(".")[:2]), v[1][:6], v[1][:4]][v[0]])) for v in values}
    holds = lambda h: {i for i in texts if any(h in pair for pair in held[i])}
    documents = {h: holds(h) for h in {h for pairs in held.values() for pair in pairs for h in pair}}
    found = set()
    for i, x in texts.items():
        for m in re.finditer(r"\w+", x):
            with_term = {j for j in texts if m[0].lower() in terms[j]}
            best = 0.0
            for value, group in held[i]:
                content = np.log(n / len(documents[value]))
                for h in (value, group):
                    share, k = len(with_term & documents[h]) / len(with_term), len(with_term)
                    z = pii.Z
                    low = (share + z * z / (2 * k) - z * np.sqrt(share * (1 - share) / k + z * z / (4 * k * k))) / (1 + z * z / k)
                    if content > 0:
                        best = max(best, (np.log(n / len(documents[h])) + np.log(low)) / content)
            if best >= pii.GENERALISE_AT and not any(a < m.end() and m.start() < b for a, _, b in base(x)):
                found.add((i, m.start(), m.end()))
    return found


def test_term_spans_by_brute_force(spark):
    """Rare values, values that share a class, one value in a third of all documents, several values in one text, repeated texts."""
    import random

    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ünal", "bo", "7", "x_1"]
    texts = {}
    for i in range(240):
        some = [words[min(int(rng.expovariate(0.06)), len(words) - 1)] for _ in range(12)]
        if i % 3 == 0:
            some += ["hot@mail.org", "harbour"]
        if i % 8 == 0:
            some += [f"u{i}@rare{i % 5}.net", f"Firm{i % 5}", f"only{i}"]
        if i % 20 == 0:
            some += [f"10.{i % 3}.0.{i}", "rack", "+1 (736) 555-2678", "caller", "only"]
        rng.shuffle(some)
        texts[i] = " ".join(some)
    texts[240] = texts[241] = "twice a@b.c twice"
    got = pii.private_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    spans = {(r.doc_id, *map(int, s.split(":")[1:])) for r in got for s in r.spans.split(",") if s.startswith("term:")}
    assert spans == term_spans(texts) and len(spans) > 50


def test_private_edges(edge, nothing):
    got = pii.private_spans(edge).collect()
    assert len(got) == edge.count() and {r.doc_id for r in got if r.n_email + r.n_ip + r.n_card + r.n_phone} == {14}
    clean = pii.sanitise(edge)
    assert clean.columns == edge.columns and clean.count() == edge.count()
    assert {r.text for r in clean.filter("doc_id = 14").collect()} == {"mail [EMAIL] or [PHONE], [IP]; [CARD] end"}
    assert pii.private_spans(nothing).count() == 0 and pii.sanitise(nothing).count() == 0


def test_private_runs_no_python(spark, tiny):
    from casewise.llm.queries import QUERIES

    plan = QUERIES["op8_private_data"](spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_top_k_matches_sql(results, tables):
    assert sorted(map(tuple, results("op6_exact_top_k"))) == sorted(tables.execute(ORACLES["op6_exact_top_k"]).fetchall())


@pytest.mark.parametrize("k", [1, 3, 20])
def test_top_k_brute_force(spark, k):
    rng = np.random.default_rng(k)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.4, 6).round(1)]) for i in range(240)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(120)]  # a third are equal
    vectors += [(500, None), (501, []), (502, [float("nan")] * 6), (503, [None] * 6), (504, [float("inf")] + [0.0] * 5), (505, [9.0, -9.0]), (506, [1.0, 1.0]), (None, [1.0] * 6), (20, vectors[20][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in vafile.top_k(frame, F.col("vec_id") % 5 == 0, k=k).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    fine = {i: np.floor(np.array(v, np.float32).astype(float) * 64).astype(int) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q, v in fine.items():
        if q % 5 == 0:
            want = sorted((-int(v @ o), i) for i, o in fine.items() if i != q and len(o) == len(v))[:k]
            assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {q for q in fine if q % 5 == 0}


def test_equal_vectors_of_repeated_rows(spark):
    """Rows that stand several times don't use up the places of a class."""
    rows = [(i, [0.5, 0.5]) for i in range(30)] * 2 + [(0, [0.5, 0.5])] * 25 + [(100 + i, [0.25, 0.25]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = vafile.top_k(frame, F.col("vec_id") == 29, k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "vec_id long, embedding array<float>")
    whole = vafile.top_k(frame, F.col("vec_id") % 10 == 0, k=5).collect()
    for name, value in (("BLOCK_ROWS", 50), ("QUERY_ROWS", 7), ("CHUNK", 16)):
        monkeypatch.setattr(vafile, name, value)
    assert sorted(map(tuple, whole)) == sorted(map(tuple, vafile.top_k(frame, F.col("vec_id") % 10 == 0, k=5).collect()))


def test_scan_keeps_the_best():
    rng = np.random.default_rng(2)
    v = rng.integers(-40, 40, (500, 8))
    q = rng.integers(-40, 40, (9, 8)).astype(np.int32)
    low, width = v.min(axis=0), (v.max(axis=0) - v.min(axis=0)) // vafile.CELLS + 1
    rows, cols, lower, upper = vafile.scan(q, ((v - low) // width).astype(np.uint8), low, width, 4)
    exact = q @ v.T
    assert ((lower <= exact[rows, cols]) & (exact[rows, cols] <= upper)).all()
    for i in range(len(q)):
        assert set(np.argsort(-exact[i], kind="stable")[:4]) <= set(cols[rows == i]) and (rows == i).sum() < 500


@pytest.mark.parametrize("size", [1e9, 3e13, 1e300])
def test_top_k_of_large_components(spark, size):
    """Finite components of any size: products beyond 64 bits are ranked exactly, also where doubles would tie."""
    rng = np.random.default_rng(6)
    vectors = [(i, [float(size * rng.choice([-1, 1, 0.5])), float(rng.integers(-3, 4)), float(size) if i % 3 else 1.0 / 64]) for i in range(60)]
    vectors += [(200 + i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    bound = vafile.LARGEST
    whole = {i: [max(-bound, min(bound, int(np.floor(min(max(x * 64, -2.0**60), 2.0**60))))) for x in v] for i, v in vectors}
    got = defaultdict(list)
    for r in vafile.top_k(frame, F.col("vec_id") % 5 == 0, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, v in whole.items():
        if q % 5 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, o)), i) for i, o in whole.items() if i != q)[:7]
            assert got[q] == [(i, -s if abs(s) < 2**63 else None) for s, i in want]


def test_top_k_of_nothing_and_of_clashing_names(spark):
    rows = [(i, [float(i), 1.0], 1, "x", 2) for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class int, query string, rank int")
    plain = vafile.top_k(frame.select("vec_id", "embedding"), F.col("vec_id") == 3, k=3).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, vafile.top_k(frame, F.col("vec_id") == 3, k=3).collect())) and len(plain) == 3
    assert vafile.top_k(frame.limit(0), F.col("vec_id") == 3).count() == 0
