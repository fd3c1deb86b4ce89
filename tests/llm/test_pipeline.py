"""The pipeline's stages, each judged on its own input."""

import pytest

import __spark_entry__
import corpus_pipeline
from casewise.llm.queries import tokenizer


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{tiny}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tiny).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_join", "private_data", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_drops_what_is_labelled_bad(stages, tables):
    label = dict(tables.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = rows(stages[1])
    judged = [(i in kept) == bool(label[i]) for i in rows(stages[0]) if i in label]
    assert sum(judged) >= 0.95 * len(judged)


def test_copies_go(stages):
    from test_dedup import components, lowered

    before, after = rows(stages[1]), rows(stages[2])
    best = {}
    for i, r in before.items():
        best[lowered(r.text)] = max(i, best.get(lowered(r.text), i))
    assert set(after) == set(best.values())
    group = components([(i, r.text) for i, r in after.items()])
    assert set(rows(stages[3])) == {i for i, (_, least) in group.items() if least == i}


def test_private_data_goes(stages):
    from test_learned import base

    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        assert base(before[i].text) or r.text == before[i].text


def test_all_is_packed(stages):
    from test_tokens import check_pieces
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    library.no_truncation()
    library.no_padding()
    check_pieces(stages[5].collect(), {i: [r.text] for i, r in rows(stages[4]).items()}, library)


def test_run_gives_the_last_stage(spark, tiny, stages):
    got = __spark_entry__.queries()["pipeline"](spark, tiny)
    assert got.columns == stages[-1].columns
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    total = lambda r: sum(x[2] for x in r)
    assert total(key(got)) == total(key(stages[-1]))


@pytest.mark.parametrize("case", ["edge", "nothing"])
def test_stages_take_odd_tables(spark, tiny, request, case):
    docs = request.getfixturevalue(case)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() >= 0 if case == "edge" else out.count() == 0
