"""The exact reserved-credit series against a sweep over the decisions."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_segments import log, random_log

from tollgate.operators import charge as D
from tollgate.operators import metrics as M

TTL = 180 * 60_000_000
MIN = 60_000_000


def sweep(decisions):
    delta = defaultdict(int)
    held = defaultdict(dict)

    def close(uid, s, t):
        amount, opened = held[uid].pop(s)
        delta[min(t, opened + TTL) // MIN] -= amount

    for r in sorted(decisions, key=lambda r: (r.t, r.request_id)):
        if r.op == "DELETE_USER":
            for s in list(held[r.userid]):
                close(r.userid, s, r.t)
        elif r.op == "REPORT_USAGE" and 42 <= r.status <= 45:
            if r.session_id in held[r.userid]:
                close(r.userid, r.session_id, r.t)
            if r.approved:
                held[r.userid][r.session_id] = (r.approved, r.t)
                delta[r.t // MIN] += r.approved
    for uid in held:
        for s in list(held[uid]):
            close(uid, s, 1 << 60)
    out, total = {}, 0
    for m in sorted(delta):
        total += delta[m]
        out[m] = total
    return out


@pytest.mark.parametrize("seed,hot", [(1, None), (2, 1)])
def test_series_equals_a_sweep(spark, seed, hot):
    req = log(spark, random_log(seed, list(range(1, 6)), 900, hot=hot))
    users = spark.range(1, 6).select(
        F.col("id").alias("userid"), F.lit("{}").alias("user_json_object"), F.timestamp_micros(F.lit(0)).alias("user_last_seen"),
        F.lit(None).cast("long").alias("user_softlock_sessionid"), F.lit(None).cast("timestamp").alias("user_softlock_expiry"))
    dec = D.charge(req, users, users.select("userid", F.lit(5000).cast("long").alias("amount"))).decisions
    want = sweep(dec.withColumn("t", F.unix_micros("txn_time")).collect())
    got = {r.m: r.allocated_amount for r in M.value_at_risk_series(dec).select(
        F.floor(F.unix_micros("txn_time") / F.lit(MIN)).alias("m"), "allocated_amount").collect()}
    assert got == want and len(got) > 100
    assert M.value_at_risk_series(dec.limit(0)).count() == 0


def test_one_shuffle_serves_both_windows(spark):
    schema = D.charge(log(spark, random_log(3, [1, 2], 4))).decisions.schema
    dec = spark.createDataFrame([], schema)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = M.value_at_risk_series(dec)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("hashpartitioning(userid") == 1
