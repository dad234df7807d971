"""Message and log sources: the add-credit topic (S2), benchmark logs.

Decoding is a pure column function so that the same code serves a batch
DataFrame, a file stream and a Kafka stream.  Kafka itself is not installed
here; ``kafka_addcredit_stream`` is an untested thin reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate import schema as S

_CSV_SCHEMA = "userid LONG, amount LONG, txn_id STRING"


def decode_addcredit(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Decode quoted CSV values ``"userid","amount","txnid"`` into
    ADD_CREDIT fields; ``valid`` is false when a field is missing or not a
    number (PERMISSIVE parsing gives NULL there)."""
    parsed = F.from_csv(F.col(value_col), _CSV_SCHEMA, {"mode": "PERMISSIVE"})
    out = messages.withColumn("_m", parsed).select(
        "*", F.col("_m.userid").alias("userid"), F.col("_m.amount").alias("amount"),
        F.col("_m.txn_id").alias("txn_id")).drop("_m")
    valid = F.col("userid").isNotNull() & F.col("amount").isNotNull() & F.col("txn_id").isNotNull()
    return out.withColumn("valid", valid)


def addcredit_requests(messages: DataFrame, time_col: str = "txn_time", id_col: str = "request_id") -> DataFrame:
    """Valid decoded messages as ADD_CREDIT rows of the request log."""
    d = decode_addcredit(messages).filter("valid")
    return d.select(F.col(id_col).alias("request_id"), F.col(time_col).alias("txn_time"), "userid",
                    F.lit("ADD_CREDIT").alias("op"), "txn_id",
                    F.lit(None).cast("long").alias("session_id"), F.lit(None).cast("long").alias("units_used"),
                    F.lit(None).cast("long").alias("units_wanted"), "amount",
                    F.lit(None).cast("string").alias("json"), F.lit(None).cast("string").alias("delta_op"))


def addcredit_rejects(messages: DataFrame) -> DataFrame:
    """Malformed add-credit messages (the reject set)."""
    return decode_addcredit(messages).filter(~F.col("valid")).drop("valid")


def kafka_addcredit_stream(spark: SparkSession, servers: str, topic: str = "ADDCREDIT",
                           starting: str = "latest") -> DataFrame:
    """Thin reader for the add-credit topic (needs the Kafka connector on the
    classpath; not available in this environment and not tested)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting).load())
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                      F.col("timestamp").alias("txn_time"), F.col("offset").alias("request_id"))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark log text with the file each line came from."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def summary_lines(logs: DataFrame) -> DataFrame:
    """Keep only the summary lines (those carrying the marker)."""
    return logs.filter(F.col("line").contains(S.SUMMARY_MARKER + ":"))
