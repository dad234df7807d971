"""Plan-shape regressions: the properties the design relies on at scale."""

import re

import pytest
from conftest import SF_SMALL

from tollgate.plans import QUERIES as Q

SKIP = {"charge_stream", "sink_financial_events", "tail_financial_events", "user_balance_stream",
        "activity_per_minute_stream", "credit_topic_balances", "late_requests", "charge_by_segments",
        "charge_by_segments_events", "activity_windows_stream", "charge_by_segments_final_state", "charge_stream_timed",
        "reservation_releases", "user_360_live", "value_at_risk_series"}      # these run jobs while being built


def _plan(spark, name):
    return Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q) - SKIP))
def test_no_cartesian_nested_loop_or_row_udf(spark, name):
    plan = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_replay_has_one_shuffle_into_the_fold(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(spark, "charge")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    fold = plan[plan.index("MapInArrow"):]
    first_exchange = fold[fold.index("Exchange"):fold.index("\n", fold.index("Exchange"))]
    assert "hashpartitioning(userid" in first_exchange
    between = fold[:fold.index("Exchange")]
    assert "Sort [userid" in between and between.count("Exchange") == 0


UNUSED = ("props", "c_name", "c_nationkey", "c_mktsegment")     # columns no charging query needs


@pytest.mark.parametrize("name", ["user_balance", "recent_activity_out", "charge", "current_metrics",
                                  "spendable_balance", "latency_histogram"])
def test_scans_read_only_needed_columns(spark, name):
    plan = _plan(spark, name)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans
    for cols in scans:
        assert not any(c in cols.split(",") for c in UNUSED), (name, cols)


def test_minute_metric_range_reaches_the_scan(spark, tmp_path):
    """On a stored ledger, M1's 'minute before as_of' is a txn_time range
    pushed into the parquet scan, not a filter after aggregating."""
    from tollgate.operators import metrics as M
    from tollgate.sources import fixtures as fx
    fx.txns(spark, SF_SMALL).write.parquet(str(tmp_path / "txns"))
    txns = spark.read.parquet(str(tmp_path / "txns"))
    df = M.current_metrics(fx.users_locked(spark, SF_SMALL), fx.usage_keyed(spark, SF_SMALL), txns,
                           fx.METRICS_AS_OF_US)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "spent_amount" in ln][0]
    assert "GreaterThanOrEqual(txn_time" in scan and "LessThan(txn_time" in scan


def test_single_session_closed_form_has_no_python(spark):
    plan = _plan(spark, "report_usage_single_session")
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(spark, "report_usage_single_session")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    top = plan[:plan.index("Window")]
    assert "Exchange" not in top                    # the windows sit directly on one shuffle


def test_bucketed_state_needs_no_shuffle_for_per_user_work(spark, tmp_path):
    """Financial events and reservations stored bucketed by userid: the
    spendable-balance audit (two per-user aggregates and their join) plans
    without any exchange, and gives the same rows."""
    from tollgate.operators import audit as C
    from tollgate.sources import fixtures as fx
    from tollgate.sources.tables import write_bucketed
    ev = write_bucketed(fx.fin_events(spark, SF_SMALL), "t_fin_events", str(tmp_path / "ev"), 8)
    us = write_bucketed(fx.usage_keyed(spark, SF_SMALL), "t_usage", str(tmp_path / "us"), 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = C.spendable_balance(ev, us)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan
    want = sorted(tuple(r) for r in C.spendable_balance(fx.fin_events(spark, SF_SMALL),
                                                         fx.usage_keyed(spark, SF_SMALL)).collect())
    assert got == want
