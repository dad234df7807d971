"""Skew-safe building blocks for "first / top-k row per key".

A window ``row_number() over (partition by key)`` sends every row of a key to
one task, so one hot key (a third of all rows) becomes one huge sorted task.
The helpers here avoid that:

* ``first_per_key`` uses ``min(struct(order..., payload...))`` as an
  aggregate, which Spark computes partially on the map side: a hot key is
  reduced to one row per input partition before the shuffle.
* ``top_k_per_key`` ranks inside ``(key, salt)`` groups first (the salt
  spreads a hot key over ``salt_buckets`` tasks), keeps the k best of every
  salt group, and ranks the at most ``k * salt_buckets`` survivors per key.
  Exact: every global top-k row is within the top-k of its own salt group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 32


def _cols(x) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in x]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  payload: Sequence[str] = (), alias: str = "first") -> DataFrame:
    """One row per key: the smallest (order..., payload...) tuple, flattened.
    ``order`` columns must be non-null for a total order."""
    fields = list(order) + [c for c in payload if c not in order]
    agg = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in fields])).alias(alias))
    return agg.select(*keys, *[F.col(f"{alias}.{c}").alias(c) for c in fields])


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
                  salt_col: str | Column | None = None,
                  salt_buckets: int = DEFAULT_SALT_BUCKETS, rank_col: str = "rank") -> DataFrame:
    """The ``k`` first rows per key by ``order`` (ascending unless Column
    expressions say otherwise), with their 1-based rank.  ``order`` must be a
    total order within a key.  ``salt_col`` picks the salt source (default: a
    hash of the order columns)."""
    order_cols = _cols(order)
    if salt_col is None:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in order if isinstance(c, str)] or order_cols),
                      F.lit(salt_buckets))
    else:
        salt = F.pmod(F.xxhash64(F.col(salt_col) if isinstance(salt_col, str) else salt_col),
                      F.lit(salt_buckets))
    tmp = "_tk_salt"
    stage1 = (df.withColumn(tmp, salt)
              .withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys, tmp).orderBy(*order_cols)))
              .filter(F.col(rank_col) <= k).drop(rank_col, tmp))
    return (stage1.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)))
            .filter(F.col(rank_col) <= k))


def later_than_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that are not the first of their key (duplicates after the first
    occurrence).  The first is found by partial aggregation and joined back on
    the key; a hot key on the big side is split by AQE's skew-join handling
    (the small side holds one row per key)."""
    firsts = first_per_key(df, keys, order, alias="_f")
    renamed = firsts.select(*keys, F.struct(*[F.col(c) for c in order]).alias("_first"))
    joined = df.join(renamed, list(keys), "inner")
    return (joined.filter(F.struct(*[F.col(c) for c in order]) > F.col("_first"))
            .drop("_first"))
