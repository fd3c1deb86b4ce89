"""Readers and writers for delimited, JSON, ORC and partitioned tables.

Readers take an explicit schema: inference would cost one more pass over the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

JSON_FILE_ROWS = 100_000


def read_delimited(spark: SparkSession, path: str, schema, sep: str = "\t") -> DataFrame:
    """Headerless delimited text; empty fields become NULL."""
    return spark.read.csv(path, schema=schema, sep=sep, header=False, nullValue="", emptyValue="")


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header row; types are inferred only when no schema is given."""
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def read_unnamed_csv(spark: SparkSession, path: str, label: str, prefix: str, width: int) -> DataFrame:
    """Headerless numeric CSV: the first column is the label, the others one array."""
    names = [f"{prefix}{i}" for i in range(1, width + 1)]
    schema = StructType([StructField(label, LongType())] + [StructField(n, DoubleType()) for n in names])
    return spark.read.csv(path, schema=schema, header=False).select(label, F.array(*names).alias(f"{prefix}s"))


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> str:
    """Delimited text; NULL is written as an empty field."""
    df.write.mode("overwrite").csv(path, sep=sep, header=header, nullValue="", emptyValue='""', escape='"')
    return path


def write_json_lines(df: DataFrame, path: str, file_rows: int = JSON_FILE_ROWS) -> str:
    """One JSON object a line, compressed; a file can't be split, so none holds more than ``file_rows`` rows."""
    df.write.option("compression", "gzip").option("maxRecordsPerFile", file_rows).json(path)
    return path


def write_subset(df: DataFrame, condition, path: str) -> DataFrame:
    """Materialise the rows that meet ``condition`` and return the copy."""
    df.where(condition).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_orc(df: DataFrame, path: str) -> DataFrame:
    """Rewrite as compressed columnar files and return the copy."""
    df.write.mode("overwrite").orc(path)
    return df.sparkSession.read.orc(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> str:
    """Replace only the partitions present in ``df``.

    The rebalance hint lets adaptive execution write few files for small key values and split a
    large one over several writers.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    return path


def as_view(df: DataFrame, name: str) -> SparkSession:
    """Register a table for ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession
