"""Column expressions: text parsing, durations, ratios and small numeric rules.

Every function takes column names or Columns and returns a Column built from Spark's own
expressions, so it stays inside code generation. All are safe under ANSI mode: bad input gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted timestamp formats, tried in this order.
MIXED_FORMATS = ("d/M/yyyy H:mm", "d-M-yyyy H:mm:ss")
# Month abbreviations in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
# Fixed value: two-digit years up to this one belong to 20xx.
YEAR_PIVOT = 68

SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_percent(c) -> Column:
    """``"13.5%"`` -> 13.5."""
    return F.trim(F.replace(_col(c), F.lit("%"), F.lit(""))).try_cast("double")


def parse_tenure(c) -> Column:
    """``"< 1 year"`` -> 0, ``"10+ years"`` -> 10, no number -> NULL."""
    digits = F.nullif(F.regexp_extract(_col(c), r"(\d{1,2})", 1), F.lit(""))
    return F.when(F.contains(_col(c), F.lit("< 1")), 0).otherwise(digits.try_cast("int"))


def parse_month_year(c) -> Column:
    """``"Dec-11"`` -> 2011-12-01, with 00-68 read as 20xx and 69-99 as 19xx."""
    parts = F.split(F.trim(_col(c)), "-")
    names = F.array(*[F.lit(m) for m in MONTHS])
    month = F.array_position(names, F.initcap(F.get(parts, 0))).cast("int")
    short = F.get(parts, 1).try_cast("int")
    year = short + F.when(short <= YEAR_PIVOT, 2000).otherwise(1900)
    return F.when((month > 0) & short.between(0, 99), F.make_date(year, month, F.lit(1)))


def parse_mixed_timestamp(c, formats: Sequence[str] = MIXED_FORMATS) -> Column:
    """First format that fits wins."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats])


def parse_date(c, fmt: str = "dd-MM-yyyy") -> Column:
    return F.try_to_timestamp(_col(c), F.lit(fmt)).cast("date")


def epoch_year(c) -> Column:
    return F.year(F.timestamp_seconds(_col(c)))


def epoch_month(c) -> Column:
    return F.month(F.timestamp_seconds(_col(c)))


def duration(start, end, unit: str = "minutes") -> Column:
    """``end - start`` as a double in ``unit``."""
    micros = F.unix_micros(_col(end)) - F.unix_micros(_col(start))
    return micros / F.lit(1e6 * SECONDS[unit])


def compose_key(*cols, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[_col(c) for c in cols])


def format_year_month(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def leading_token(c) -> Column:
    """First alphabetic run of a name; text without one is returned unchanged."""
    found = F.regexp_extract(_col(c), r"([A-Za-z]+)", 1)
    return F.when(found != "", found).otherwise(_col(c))


def word_count(c) -> Column:
    """Pieces between single spaces, empty pieces counted."""
    return F.size(F.split(_col(c), " ")).cast("long")


def helpful_percent(c, min_votes: int = 10) -> Column:
    """``[found, total]`` -> found/total*100 where total is at least ``min_votes``."""
    total = F.get(_col(c), 1)
    return F.when(total >= max(min_votes, 1), F.try_divide(F.get(_col(c), 0), total) * 100)


def fixed_width_bin(c, width: float, origin: float = 0.0) -> Column:
    return F.floor((_col(c) - origin) / width)


def truncate_decimals(c, places: int = 3) -> Column:
    """Cut off, without rounding; exact for decimals."""
    scale = 10**places
    return (F.floor(F.abs(_col(c)) * scale) * F.signum(_col(c).cast("double"))).cast("double") / scale


def round_decimals(c, places: int = 2) -> Column:
    return F.round(_col(c), places)


def column_ratio(top, bottom) -> Column:
    return F.try_divide(_col(top), _col(bottom))


def derive_flag(condition: Column) -> Column:
    """1 / 0, and NULL where the condition is NULL."""
    return F.when(condition, 1).when(~condition, 0)


def row_mean(array_col) -> Column:
    c = _col(array_col)
    return F.try_divide(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), F.size(c))


def row_null_count(cols: Sequence[str]) -> Column:
    return F.size(F.filter(F.array(*[F.col(c).isNull() for c in cols]), lambda missing: missing)).cast("long")


def scale_constant(array_col, divisor: float) -> Column:
    return F.transform(_col(array_col), lambda x: x / F.lit(float(divisor)))
