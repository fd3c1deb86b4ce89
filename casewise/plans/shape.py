"""Output shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, ShortType


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles (and drop the sign of zero) and widen small integers."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            c = F.round(c, places) + F.lit(0.0)
        elif isinstance(field.dataType, (IntegerType, ShortType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)
