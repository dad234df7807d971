"""Readers for the driver's parquet tables and for the charging relations.

Readers select only the columns a caller needs so that the parquet scan's
ReadSchema stays narrow; filters applied later are pushed into the scan by
Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tollgate import schema as S


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def read_relation(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read a stored relation with an explicit schema (no inference)."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_relation(spark, path, S.USERS)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return read_relation(spark, path, S.USAGE)


def read_txns(spark: SparkSession, path: str) -> DataFrame:
    return read_relation(spark, path, S.TXNS)


def read_fin_events(spark: SparkSession, path: str) -> DataFrame:
    return read_relation(spark, path, S.FIN_EVENTS)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return read_relation(spark, path, S.REQUESTS)


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "userid") -> DataFrame:
    """Store a state table bucketed and sorted by ``key`` (a table in the
    session catalog over files at ``path``).  Per-user aggregates and joins
    between tables bucketed the same way then need no shuffle.  Returns the
    table read back.  Across sessions the bucketing is known only to a
    persistent catalog; files alone are read as plain parquet."""
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)
