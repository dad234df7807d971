"""Benchmark-log analytics (B1-B4): the summary line the load client prints
after each run, parsed into typed columns, and the sweep verdicts built on it.

Line format (writer order, Q17):
``yyyy-MM-dd HH:mm:ss:GREPABLE SUMMARY:<tpms>:<tps>:`` followed by three
blocks (RQU, KV_PUT, KV_GET) of ``avg:p50:p99:p99.9:p99.99:p99.999:max:max_freq:``.
Latencies are microseconds; max_freq is a count printed as a double (``3.0``,
``1.2E7``).  Gathered logs put any colon-separated prefix before the time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate import schema as S

STATS = ("avg", "p50", "p99", "p99_9", "p99_99", "p99_999", "max", "max_freq")


def summary_columns() -> list[str]:
    return [f"{b.lower()}_{s}" for b in S.SUMMARY_BLOCKS for s in STATS]


def parse_run_summary(lines: DataFrame) -> DataFrame:
    """B1: one typed row per summary line: file, run_time, tpms, tps, the 24
    latency figures and ``rejected``.  Lines without the marker are skipped; a
    line with a field that is missing or no number, or without a time right
    before the marker, is rejected and has NULL there."""
    marker = S.SUMMARY_MARKER + ":"
    line = F.col("line")
    body = F.split(F.substring_index(line, marker, -1), ":")
    head = F.regexp_extract(line, r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d):" + marker, 1)
    cols = [F.try_to_timestamp(head, F.lit(S.LOG_TIME_FORMAT)).alias("run_time"),
            F.get(body, F.lit(0)).try_cast("long").alias("tpms"),
            F.get(body, F.lit(1)).try_cast("double").alias("tps")]
    for i, name in enumerate(summary_columns()):
        kind = "double" if name.endswith("max_freq") else "long"
        cols.append(F.get(body, F.lit(2 + i)).try_cast(kind).alias(name))
    parsed = lines.filter(line.contains(marker)).select("file", *cols)
    missing = F.lit(False)
    for c in parsed.columns[1:]:
        missing = missing | F.col(c).isNull()
    return parsed.withColumn("rejected", missing)


def summary_long(parsed: DataFrame) -> DataFrame:
    """B1 long form: (file, run_time, tpms, tps, proc, stat, value)."""
    items = ", ".join(f"'{b}', '{s}', cast({b.lower()}_{s} as double)" for b in S.SUMMARY_BLOCKS for s in STATS)
    n = len(S.SUMMARY_BLOCKS) * len(STATS)
    return parsed.selectExpr("file", "run_time", "tpms", "tps", f"stack({n}, {items}) as (proc, stat, value)")


def sweep_verdict(parsed: DataFrame, ratio: float = S.PASS_RATIO) -> DataFrame:
    """B2: a step passed when tps / (tpms * 1000) > ratio; a sweep (one file)
    stops at its first failed step, so steps at or after it are out."""
    target = F.col("tpms") * F.lit(1000)
    # a zero target divides to +inf (passes) for any positive tps, as double division does
    passed = F.when(target == 0, F.col("tps") > 0).otherwise((F.col("tps") / target) > F.lit(ratio))
    per_file = Window.partitionBy("file")
    return (parsed.filter(~F.col("rejected")).select("file", "tpms", "tps", passed.alias("passed"))
            .withColumn("first_failure", F.min(F.when(~F.col("passed"), F.col("tpms"))).over(per_file))
            .withColumn("in_sweep", F.col("first_failure").isNull() | (F.col("tpms") < F.col("first_failure"))))


def sla_limit(parsed: DataFrame, sla_ms: int = S.SLA_P99_MS) -> DataFrame:
    """Per file the highest target rate whose report-usage p99 stays within
    the SLA (NULL when no step does)."""
    return (parsed.filter(~F.col("rejected")).groupBy("file")
            .agg(F.max(F.when(F.col("rqu_p99") <= sla_ms * 1000, F.col("tpms"))).alias("max_tpms_within_sla")))


def fleet_total(parsed: DataFrame) -> DataFrame:
    """Per target rate over parallel clients (files): clients, summed tps
    and the worst report-usage p99."""
    return (parsed.filter(~F.col("rejected")).groupBy("tpms")
            .agg(F.count(F.lit(1)).alias("clients"), F.sum("tps").alias("total_tps"),
                 F.max("rqu_p99").alias("max_rqu_p99")))
