"""Registered queries of the latency analytics (H1-H7) and benchmark-log
analytics (B1-B4)."""

from __future__ import annotations

from tollgate import schema as S
from tollgate.operators import latency as H
from tollgate.operators import runlogs as B
from tollgate.plans.registry import register
from tollgate.sources import fixtures as fx

_B = "least(greatest(latency, 0), 99999)"
_HIST = f"SELECT type, {_B} AS bucket, CAST(sum(how_many) AS BIGINT) AS how_many FROM latency GROUP BY type, {_B}"


@register("latency_histogram", _HIST, ("latency",))
def latency_histogram(spark, sf):
    """H1: weight per (type, clamped bucket)."""
    return H.latency_histogram(fx.latency(spark, sf))


@register("latency_summary", f"""
SELECT type, CAST(sum(n) AS BIGINT) AS reports, CAST(sum(bucket * n) AS BIGINT) AS total,
       max(bucket) AS max_bucket, arg_max(n, bucket) AS max_bucket_count,
       CAST(sum(under_n) AS BIGINT) AS under_reports, CAST(sum(over_n) AS BIGINT) AS over_reports,
       CAST(sum(bucket * n) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS average
FROM (SELECT type, {_B} AS bucket, CAST(sum(how_many) AS BIGINT) AS n,
             count(CASE WHEN latency < 0 THEN 1 END) AS under_n,
             count(CASE WHEN latency >= 100000 THEN 1 END) AS over_n
      FROM latency GROUP BY type, {_B})
GROUP BY type""", ("latency",))
def latency_summary(spark, sf):
    """H2: reports, total, average, top bucket and under/over counts per type."""
    return H.latency_summary(fx.latency(spark, sf))


_PCTS = ", ".join(f"({p!r})" for p in S.PERCENTILES)


@register("latency_percentiles", f"""
SELECT c.type, p.pct, coalesce(min(CASE WHEN CAST(c.cum AS DOUBLE) >= CAST(c.total AS DOUBLE) * (p.pct / 100)
                                          AND c.how_many > 0 THEN c.bucket END), 0) AS bucket
FROM (SELECT type, bucket, how_many,
             sum(how_many) OVER (PARTITION BY type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(how_many) OVER (PARTITION BY type) AS total
      FROM ({_HIST})) c,
     (SELECT CAST(col0 AS DOUBLE) AS pct FROM (VALUES {_PCTS})) p
GROUP BY c.type, p.pct""", ("latency",))
def latency_percentiles(spark, sf):
    """H3: percentile buckets (50 ... 99.999) per type."""
    return H.latency_percentiles(fx.latency(spark, sf))


@register("histogram_subtract", f"""
SELECT bucket, CAST(coalesce(big, 0) - coalesce(small, 0) AS BIGINT) AS how_many,
       (SELECT CAST(sum(how_many) AS BIGINT) FROM ({_HIST}) WHERE type = 'click') AS reports
FROM (SELECT coalesce(b.bucket, s.bucket) AS bucket, b.how_many AS big, s.how_many AS small
      FROM (SELECT bucket, how_many FROM ({_HIST}) WHERE type = 'click') b
      FULL OUTER JOIN (SELECT bucket, how_many FROM ({_HIST}) WHERE type = 'view') s ON b.bucket = s.bucket) j
WHERE bucket < (SELECT max(bucket) FROM ({_HIST}) WHERE type IN ('click', 'view'))""", ("latency",))
def histogram_subtract(spark, sf):
    """H4: click histogram minus view histogram (top bucket dropped)."""
    return H.histogram_subtract(H.latency_histogram(fx.latency(spark, sf)), "click", "view")


@register("bucket_first_comment", f"""
SELECT type, {_B} AS bucket, arg_min(comment, seq) AS comment FROM latency
WHERE comment IS NOT NULL AND length(comment) > 0 GROUP BY type, {_B}""", ("latency",))
def bucket_first_comment(spark, sf):
    """H5: first non-empty comment per bucket."""
    return H.bucket_first_comment(fx.latency(spark, sf))


@register("size_histogram", """
SELECT type, least(latency, 99999) AS size, count(*) AS how_many, arg_max(comment, seq) AS comment
FROM latency WHERE latency >= 0 GROUP BY type, least(latency, 99999)""", ("latency",))
def size_histogram(spark, sf):
    """H6: size counts (negatives ignored, overflow in the last slot)."""
    return H.size_histogram(fx.latency(spark, sf))


@register("counters", "SELECT type, CAST(sum(how_many) AS BIGINT) AS counter FROM latency WHERE how_many <> 0 GROUP BY type",
          ("latency",))
def counters(spark, sf):
    """H7: keyed counters summed by quantity."""
    return H.counters(fx.latency(spark, sf))


def _parsed_sql() -> str:
    time = f"regexp_extract(line, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}):{S.SUMMARY_MARKER}:', 1)"
    cols = {"run_time": f"try_strptime({time}, '%Y-%m-%d %H:%M:%S')",
            "tpms": "TRY_CAST(split_part(body, ':', 1) AS BIGINT)", "tps": "TRY_CAST(split_part(body, ':', 2) AS DOUBLE)"}
    for i, name in enumerate(B.summary_columns()):
        kind = "DOUBLE" if name.endswith("max_freq") else "BIGINT"
        cols[name] = f"TRY_CAST(split_part(body, ':', {i + 3}) AS {kind})"
    listed = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    missing = " OR ".join(f"{k} IS NULL" for k in cols)
    return (f"SELECT *, ({missing}) AS rejected FROM (SELECT file, {listed} FROM (SELECT file, line, "
            f"split_part(line, '{S.SUMMARY_MARKER}:', 2) AS body FROM run_log WHERE contains(line, '{S.SUMMARY_MARKER}:')))")


_PARSED = {"parsed_runs": _parsed_sql()}


def _parsed(spark, sf):
    return B.parse_run_summary(fx.run_log(spark, sf))


@register("parse_run_summary", "SELECT * FROM parsed_runs", ("run_log",), extra=_PARSED)
def parse_run_summary(spark, sf):
    """B1: typed rows of the benchmark summary lines."""
    return _parsed(spark, sf)


@register("sweep_verdict", """
SELECT file, tpms, tps, passed, first_failure, (first_failure IS NULL OR tpms < first_failure) AS in_sweep
FROM (SELECT file, tpms, tps, tps / (tpms * 1000) > 0.9 AS passed,
             min(CASE WHEN NOT (tps / (tpms * 1000) > 0.9) THEN tpms END) OVER (PARTITION BY file) AS first_failure
      FROM parsed_runs WHERE NOT rejected)""", ("run_log",), extra=_PARSED)
def sweep_verdict(spark, sf):
    """B2: pass/fail per step and whether the step is before the first failure."""
    return B.sweep_verdict(_parsed(spark, sf))


@register("sla_limit", """
SELECT file, max(CASE WHEN rqu_p99 <= 10000 THEN tpms END) AS max_tpms_within_sla
FROM parsed_runs WHERE NOT rejected GROUP BY file""",
          ("run_log",), extra=_PARSED)
def sla_limit(spark, sf):
    """Highest target rate within the p99 SLA per run series."""
    return B.sla_limit(_parsed(spark, sf))


@register("fleet_total", """
SELECT tpms, count(*) AS clients, sum(tps) AS total_tps, max(rqu_p99) AS max_rqu_p99
FROM parsed_runs WHERE NOT rejected GROUP BY tpms""",
          ("run_log",), extra=_PARSED)
def fleet_total(spark, sf):
    """Per target rate, totals over parallel clients."""
    return B.fleet_total(_parsed(spark, sf))
