import os

import duckdb
import pytest

from casewise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, score double, digest string, _spans int, row int"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


PASSAGE = words(70, 900)
EDGE_TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one"), (6, "One"), (6, "One"), (None, "one"), (None, None),
    (7, words(200)), (8, words(200).upper()), (9, words(199) + " changed"), (10, words(120, 5000) + " " + PASSAGE), (11, PASSAGE + " " + words(300, 7000)),
    (12, "x" * 60_000), (13, "1 " * 30_000), (14, "mail a.b@c.de or +1 (736) 555-2678, 10.0.0.1; 4111 1111 1111 1111 end"),
    (15, "\x1cé́ Σ ΑΣ <|endoftext|> İ 中文 😀 `~ \\### </turn>"), (16, "a b c d"), (17, "A B c d"), (18, words(5)), (18, words(40, 40)),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators like to use."""
    rows = [(i, t, "en" if i and i % 2 else None, None, 7, "i", "k", 0.5, "d", 1, 2) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(tiny):
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def tables(tiny):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(tiny, name)}.parquet'")
    return con


@pytest.fixture(scope="session")
def results(spark, tiny):
    """Each query's rows over the smallest data set, run once."""
    held = {}

    def get(name):
        if name not in held:
            held[name] = QUERIES[name](spark, tiny).collect()
        return held[name]

    return get
