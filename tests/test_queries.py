"""Every registered query against its SQL on the smallest data set."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from casewise.plans import load

# The optional operators have tests of their own.
QUERIES, ORACLES = dict(load().QUERIES), dict(load().ORACLES)
# Fits that need more rows than the smallest data set has.
SLOW = {"cross_validate_grid", "stepwise_aic_logistic", "backward_eliminate_logistic"}


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


def table(columns, rows):
    """Rows as (exact values, floats), columns by name, sorted by the exact values first."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    split = []
    for r in rows:
        values = [r[i] for i in order]
        exact = [plain(v) for v in values if not isinstance(v, float)]
        split.append((exact, [v for v in values if isinstance(v, float)]))
    return sorted(split)


def same(got, want):
    """Floats may differ in the last rounded place: sums are taken in another order."""
    if len(got) != len(want):
        return False
    for (a, x), (b, y) in zip(got, want):
        if a != b or len(x) != len(y):
            return False
        if not all(p == q or math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6) for p, q in zip(x, y)):
            return False
    return True


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, tiny, duck, key):
    got = QUERIES[key](spark, tiny)
    want = duck.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert same(table(got.columns, got.collect()), table(names, want.fetchall()))


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs_without_sql(spark, tiny, key):
    """Rows, and in every row some value."""
    rows = QUERIES[key](spark, tiny).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["country_code", "total_activity"]
    assert entry.entry(spark).count() == 1
