"""Query registry: key -> (Spark callable, DuckDB SQL)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewise.plans.lens_sql import LENS_SQL
from casewise.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_lenses(sql: str, lenses: str) -> str:
    """Put the lens definitions in front of ``sql`` as common table expressions."""
    ctes = ", ".join(f"{name} AS ({LENS_SQL[name]})" for name in lenses.split())
    body = sql.strip()
    head = re.match(r"WITH(\s+RECURSIVE)?\s", body)
    if head is None:
        return f"WITH {ctes} {body}" if ctes else body
    start = "WITH RECURSIVE" if head.group(1) else "WITH"
    return f"{start} {ctes}, {body[head.end():]}" if ctes else body


def query(key: str, lenses: str = "", sql: str | None = None):
    """Register a query; ``sql`` may use the named lenses as tables."""

    def register(run):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = lambda spark, folder: run(configure(spark), folder)
        if sql is not None:
            ORACLES[key] = with_lenses(sql, lenses)
        return run

    return register
