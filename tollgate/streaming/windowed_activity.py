"""A6, A7 and A9 as one-minute event-time windows in the state store.

Every task first adds up its rows per minute (a stateless Arrow step), so a
minute of any size reaches the state operator as one row per task.  The state
holds the sums of open minutes only: when the watermark passes a minute's end, a
timer writes its row, once, and clears it.  Rows of a minute that has been closed
are not dropped: their sums leave at once as ``late`` rows and are merged with
the minute's final row by ``activity_minutes``, which also adds the minutes that
are still open from the state of the checkpoint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tollgate.functions.columns import micros
from tollgate.streaming.charge_stream import ROCKSDB

MINUTE_US = 60 * 1_000_000
SUMS = ("out_approved_amount", "out_spent_amount", "out_how_many", "in_approved_amount", "in_spent_amount", "in_how_many",
        "how_many")
PARTS = T.StructType([T.StructField("minute", T.LongType()), *(T.StructField(c, T.LongType()) for c in SUMS)])
OUTPUT = T.StructType([*PARTS.fields, T.StructField("late", T.BooleanType())])


def minute_parts(txns: DataFrame) -> DataFrame:
    """Sums per minute and task (null where a view has no rows): out = spent <= 0, in = spent > 0."""
    out, inn = F.col("spent_amount") <= 0, F.col("spent_amount") > 0
    one = F.lit(1).cast("long")
    t = micros("txn_time")
    rows = txns.select((t - F.pmod(t, F.lit(MINUTE_US))).alias("minute"),
                       F.when(out, -F.col("approved_amount")).alias("out_approved_amount"),
                       F.when(out, F.col("spent_amount")).alias("out_spent_amount"), F.when(out, one).otherwise(0).alias("out_how_many"),
                       F.when(inn, F.col("approved_amount")).alias("in_approved_amount"),
                       F.when(inn, F.col("spent_amount")).alias("in_spent_amount"), F.when(inn, one).otherwise(0).alias("in_how_many"),
                       one.alias("how_many"))

    def summed(table: pa.Table) -> pa.Table:
        sums = table.group_by("minute").aggregate([(c, "sum") for c in SUMS])
        return sums.select(["minute", *(f"{c}_sum" for c in SUMS)]).rename_columns(PARTS.names)

    def run(batches):
        held = None
        for batch in batches:
            part = summed(pa.Table.from_batches([batch]))
            held = part if held is None else summed(pa.concat_tables([held, part]))
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, PARTS)


def added(held, row) -> tuple:
    """Sums of two parts of a minute; a null adds nothing."""
    return tuple(b if a is None else a if b is None else a + b for a, b in zip(held, row, strict=True))


class MinuteProcessor(StatefulProcessor):
    """The sums of one open minute."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", ", ".join(f"{c} BIGINT" for c in SUMS))

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row
        held = self.sums.get()
        total = held
        for r in rows:
            part = tuple(r[c] for c in SUMS)
            total = part if total is None else added(total, part)
        end = key[0] // 1000 + MINUTE_US // 1000
        if held is None and end <= timerValues.getCurrentWatermarkInMs():
            yield Row(*OUTPUT.names)(key[0], *total, True)
            return
        if held is None:
            self.handle.registerTimer(end)
        self.sums.update(tuple(total))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from pyspark.sql import Row
        total = self.sums.get()
        self.sums.clear()
        yield Row(*OUTPUT.names)(key[0], *total, False)

    def close(self) -> None:
        pass


def activity_windows(txns: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream of minutes: final rows when the watermark passes their end, late ones at once."""
    txns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the rows go on without the watermarked column, so none is dropped by it
    parts = minute_parts(txns.withWatermark("txn_time", watermark))
    return parts.groupBy("minute").transformWithState(statefulProcessor=MinuteProcessor(), outputStructType=OUTPUT,
                                                      outputMode="Append", timeMode="EventTime")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_time", F.timestamp_micros("minute")).select("txn_time", *SUMS)


def closed_minutes(spark: SparkSession, out_path: str, late: bool | None = None) -> DataFrame:
    """What the stream wrote: final rows, late rows or both."""
    df = spark.read.schema(OUTPUT).parquet(out_path)
    return _named(df if late is None else df.where(F.col("late") == late))


def open_minutes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The minutes that the state still holds."""
    df = spark.read.format("statestore").option("stateVarName", "sums").load(checkpoint)
    return _named(df.select("key.minute", "value.*"))


def activity_minutes(spark: SparkSession, out_path: str, checkpoint: str) -> DataFrame:
    """All minutes: closed ones, what came late for them, and open ones (of a
    stopped query; with a running one the two may be a batch apart)."""
    rows = closed_minutes(spark, out_path).unionByName(open_minutes(spark, checkpoint))
    return rows.groupBy("txn_time").agg(*[F.sum(c).alias(c) for c in SUMS])


__all__ = ["activity_windows", "activity_minutes", "closed_minutes", "open_minutes", "minute_parts"]
