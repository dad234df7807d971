"""Latency analytics over a table of measurements (H1-H7).

Input rows: (seq, type, latency, comment, how_many).  A histogram is held as
rows (type, bucket, how_many); it has at most ``max_size`` rows per type, so
per-type windows over it are bounded by the bucket count, not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate import schema as S

DEFAULT_MAX_SIZE = 100_000


def _bucket(max_size: int):
    return F.least(F.greatest(F.col("latency"), F.lit(0)), F.lit(max_size - 1))


def latency_histogram(latency: DataFrame, max_size: int = DEFAULT_MAX_SIZE) -> DataFrame:
    """H1: weight per (type, bucket); negatives go to bucket 0 and values at or
    above ``max_size`` to the last bucket."""
    return (latency.select("type", _bucket(max_size).alias("bucket"), "how_many")
            .groupBy("type", "bucket").agg(F.sum("how_many").cast("long").alias("how_many")))


def latency_summary(latency: DataFrame, max_size: int = DEFAULT_MAX_SIZE) -> DataFrame:
    """H2: per type the report count, the latency total sum(bucket * n), the
    average, the largest bucket used and its weight, and the under/over
    counts, which rise by one per report whatever its weight (Q16).  The raw
    rows are reduced to histogram rows first; the per-type step reads those."""
    hist = (latency.select("type", _bucket(max_size).alias("bucket"), "how_many", "latency")
            .groupBy("type", "bucket").agg(
                F.sum("how_many").cast("long").alias("n"),
                F.count(F.when(F.col("latency") < 0, 1)).alias("under"),
                F.count(F.when(F.col("latency") >= max_size, 1)).alias("over")))
    return (hist.groupBy("type").agg(
                F.sum("n").alias("reports"),
                F.sum(F.col("bucket").cast("long") * F.col("n")).alias("total"),
                F.max("bucket").alias("max_bucket"),
                F.max_by("n", "bucket").alias("max_bucket_count"),
                F.sum("under").alias("under_reports"),
                F.sum("over").alias("over_reports"))
            .withColumn("average", F.when(F.col("reports") != 0,
                                          F.col("total").cast("double") / F.col("reports"))))


def latency_percentiles(latency: DataFrame, percentiles=S.PERCENTILES,
                        max_size: int = DEFAULT_MAX_SIZE) -> DataFrame:
    """H3: per type and percentile p the smallest bucket whose cumulative
    weight reaches total * (p / 100).  The running sum is a window over the
    histogram rows of one type."""
    hist = latency_histogram(latency, max_size)
    w = Window.partitionBy("type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy("type")
    cum = hist.select("type", "bucket", "how_many", F.sum("how_many").over(w).alias("cum"),
                      F.sum("how_many").over(tot).alias("total"))
    # the first bucket whose cumulative weight reaches the target always has
    # weight (a zero-weight bucket repeats the previous cumulative); when the
    # total is 0 nothing qualifies and the answer is bucket 0
    aggs = [F.min(F.when((F.col("cum") >= F.col("total") * F.lit(p / 100.0)) & (F.col("how_many") > 0),
                         F.col("bucket"))).alias(f"p{i}")
            for i, p in enumerate(percentiles)]
    per_type = cum.groupBy("type").agg(*aggs)
    stack = "stack({n}, {items}) as (pct, bucket)".format(
        n=len(percentiles), items=", ".join(f"cast({p!r} as double), coalesce(p{i}, 0)"
                                            for i, p in enumerate(percentiles)))
    return per_type.selectExpr("type", stack)


def histogram_subtract(hist: DataFrame, big_type: str, small_type: str) -> DataFrame:
    """H4: big - small per bucket below the larger of the two highest used
    buckets (the top bucket itself is dropped, Q16); reports are big's.  One
    grouped aggregate pairs the two histograms per bucket; size and reports
    are windows over those rows (at most ``max_size`` of them)."""
    t = F.col("type")
    pair = (hist.filter(t.isin(big_type, small_type)).groupBy("bucket")
            .agg(F.sum(F.when(t == big_type, F.col("how_many"))).alias("big"),
                 F.sum(F.when(t == small_type, F.col("how_many"))).alias("small")))
    everything = Window.partitionBy()
    return (pair.withColumn("size", F.max("bucket").over(everything))
            .withColumn("reports", F.sum("big").over(everything).cast("long"))
            .filter(F.col("bucket") < F.col("size"))
            .select("bucket", (F.coalesce("big", F.lit(0)) - F.coalesce("small", F.lit(0))).alias("how_many"),
                    "reports"))


def bucket_first_comment(latency: DataFrame, max_size: int = DEFAULT_MAX_SIZE) -> DataFrame:
    """H5: the first non-empty comment of each (type, bucket), by seq."""
    return (latency.filter(F.col("comment").isNotNull() & (F.length("comment") > 0))
            .select("type", _bucket(max_size).alias("bucket"), "comment", "seq")
            .groupBy("type", "bucket").agg(F.min_by("comment", "seq").alias("comment")))


def size_histogram(latency: DataFrame, max_size: int = DEFAULT_MAX_SIZE, size_col: str = "latency"
                   ) -> DataFrame:
    """H6: count per (type, size); negative sizes are ignored, sizes at or
    above ``max_size`` count in the last slot; the last comment (by seq) wins,
    empty comments included."""
    size = F.least(F.col(size_col), F.lit(max_size - 1))
    return (latency.filter(F.col(size_col) >= 0)
            .select("type", size.alias("size"), "comment", "seq")
            .groupBy("type", "size").agg(F.count(F.lit(1)).alias("how_many"),
                                         F.max_by("comment", "seq").alias("comment")))


def counters(latency: DataFrame, qty_col: str = "how_many") -> DataFrame:
    """H7: keyed counters incremented by a quantity (zero increments are
    ignored, so a counter only exists once a non-zero quantity arrived)."""
    return (latency.filter(F.col(qty_col) != 0).groupBy("type")
            .agg(F.sum(qty_col).cast("long").alias("counter")))


def set_counters(existing: DataFrame, new: DataFrame) -> DataFrame:
    """H7 setCounter: a counter that exists keeps its value (the new value is
    ignored, Q16); missing counters take the new value."""
    return (new.join(existing.select("type", F.col("counter").alias("old")), "type", "full_outer")
            .select("type", F.coalesce("old", "counter").alias("counter")))
