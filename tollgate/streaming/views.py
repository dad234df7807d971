"""Streaming forms of the views: the same column expressions as the batch
views, run incrementally.

* ``user_balance_stream`` (A2): running sum per user in ``update`` mode; the
  per-user state is unbounded by nature (a balance never expires).
* ``activity_per_minute_stream`` (A6/A7/A9 in one pass): each micro-batch
  writes partial sums per minute, added up when read, so there is no state to
  bound and no row is dropped; rows of minutes behind the watermark are marked
  late and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def user_balance_stream(fin_events: DataFrame) -> DataFrame:
    """A2 over a stream of financial events (output mode ``update``)."""
    return fin_events.groupBy("userid").agg(F.sum("amount").alias("balance"))


def activity_partials(txns: DataFrame) -> DataFrame:
    """A6, A7 and A9 per minute of txn_time and per ``late`` (a column of
    ``txns``), with the latest time: out = spent <= 0, in = spent > 0."""
    out = F.col("spent_amount") <= 0
    inn = F.col("spent_amount") > 0
    return (txns.groupBy(F.date_trunc("minute", "txn_time").alias("minute"), "late")
            .agg(F.sum(F.when(out, -F.col("approved_amount"))).alias("out_approved_amount"),
                 F.sum(F.when(out, F.col("spent_amount"))).alias("out_spent_amount"),
                 F.count(F.when(out, F.lit(1))).alias("out_how_many"),
                 F.sum(F.when(inn, F.col("approved_amount"))).alias("in_approved_amount"),
                 F.sum(F.when(inn, F.col("spent_amount"))).alias("in_spent_amount"),
                 F.count(F.when(inn, F.lit(1))).alias("in_how_many"),
                 F.count(F.lit(1)).alias("how_many"), F.max("txn_time").alias("latest"))
            .withColumnRenamed("minute", "txn_time"))


def activity_per_minute_stream(txns: DataFrame, out_path: str, checkpoint: str, watermark: str = "10 minutes",
                               timeout_s: float | None = None) -> None:
    """Run over everything available now.  Each micro-batch leaves its part of
    every minute it has rows of; a retried one replaces its own.  A minute that
    had ended ``watermark`` before the latest row of the earlier batches is
    late: it is kept apart (``late_minutes``), not dropped."""
    marks = f"{out_path}-marks"

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{marks}/batch_id={batch_id - 1}").first()["latest"] if batch_id else None
        ended = F.date_trunc("minute", "txn_time") + F.expr("interval 1 minute")
        behind = F.lit(before).cast("timestamp") - F.expr(f"interval {watermark}")
        part = activity_partials(batch.withColumn("late", F.coalesce(ended <= behind, F.lit(False))))
        path = f"{out_path}/batch_id={batch_id}"
        part.write.mode("overwrite").parquet(path)
        (spark.read.schema(part.schema).parquet(path).agg(F.greatest(F.max("latest"), F.lit(before).cast("timestamp")).alias("latest"))
         .write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}"))

    _run(txns.writeStream.foreachBatch(add), checkpoint, timeout_s)


def activity_minutes(spark: SparkSession, out_path: str) -> DataFrame:
    """The minutes of ``activity_per_minute_stream``, late rows included."""
    return _minutes(spark.read.parquet(out_path))


def late_minutes(spark: SparkSession, out_path: str) -> DataFrame:
    """What of each minute came late, with its count."""
    return _minutes(spark.read.parquet(out_path).filter("late"))


def _minutes(parts: DataFrame) -> DataFrame:
    sums = [c for c in parts.columns if c not in ("txn_time", "late", "latest", "batch_id")]
    return parts.groupBy("txn_time").agg(*[F.sum(c).alias(c) for c in sums])


def dedup_requests_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """F7 on a stream: drop a request whose (userid, txn_id) was already seen
    while that key's state is kept (until the watermark passes its first
    time plus ``delay``, the reference's one-hour horizon by default).  State
    is bounded by the watermark.  Which copy survives within one micro-batch
    is not defined; the replay fold (D9) is the exact form."""
    return (requests.withWatermark("txn_time", delay)
            .dropDuplicatesWithinWatermark(["userid", "txn_id"]))


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str, mode: str,
                 timeout_s: float | None = None) -> None:
    """Run ``stream`` over everything available now into a parquet folder; waits
    as long as that takes unless the caller sets ``timeout_s``.
    ``append`` streams write through the file sink (exactly once via its
    commit log); ``update`` streams replace each key's row through
    foreachBatch (the last update per key wins)."""
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", out_path)
    else:
        def upsert(batch: DataFrame, batch_id: int) -> None:
            (batch.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))
        w = stream.writeStream.foreachBatch(upsert)
    _run(w.outputMode(mode), checkpoint, timeout_s)


def _run(w, checkpoint: str, timeout_s: float | None) -> None:
    q = w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            raise TimeoutError("stream did not finish in time")
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def latest_per_key(spark: SparkSession, out_path: str, key: str) -> DataFrame:
    """Read an ``update``-mode result: per key the row of the last batch that
    updated it (a partial max(struct) aggregate)."""
    df = spark.read.parquet(out_path)
    vals = [c for c in df.columns if c not in (key, "batch_id")]
    latest = df.groupBy(key).agg(F.max(F.struct("batch_id", *vals)).alias("m"))
    return latest.select(key, *[F.col(f"m.{c}").alias(c) for c in vals])
