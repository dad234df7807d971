"""Invariants of the replay on random logs, through the Spark fold."""

import random

import pytest
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.operators import charge as D

BASE = 1_704_067_200_000_000


def _log(spark, seed, n=600, users=12, negative=True, used_zero=False):
    rnd = random.Random(seed)
    rows, t = [], BASE
    for i in range(n):
        t += rnd.randint(0, 90_000_000)
        uid = rnd.randint(1, users)
        op = rnd.choices(["REPORT_USAGE", "ADD_CREDIT", "UPSERT_USER", "LOCK_USER", "UPDATE_USER", "DELETE_USER"],
                         [50, 25, 8, 8, 6, 3 if negative else 0])[0]
        txn = f"T{rnd.randint(0, n // 3)}"          # repeats on purpose
        sess = rnd.choice([None, uid * 10, uid * 10 + 1, uid * 10 + 2])
        used = 0 if used_zero else rnd.randint(0, 80)
        wanted = rnd.choice([0, rnd.randint(1, 300)])
        amount = rnd.randint(-20 if negative else 0, 200)
        rows.append((i, t, uid, op, txn, sess, used, wanted, amount, "{}", None))
    df = spark.createDataFrame(rows, "request_id long, t long, userid long, op string, txn_id string, "
                                     "session_id long, units_used long, units_wanted long, amount long, "
                                     "json string, delta_op string")
    df = df.withColumn("txn_time", F.timestamp_micros("t")).drop("t")
    ids = [u for u in range(1, users + 1) if u % 4]
    users_df = spark.createDataFrame([(u, "{}", None, None, None) for u in ids], S.USERS)
    opening = spark.createDataFrame([(u, rnd.randint(0, 500)) for u in ids], "userid long, amount long")
    return df, users_df, opening


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_balances_reservations_and_ledger(spark, seed):
    reqs, users, opening = _log(spark, seed)
    r = D.charge(reqs, users=users, opening_events=opening, partitions=3).persist()
    dec = {row.request_id: row for row in r.decisions.collect()}
    assert len(dec) == reqs.count()
    deleted = {row.userid for row in reqs.filter("op = 'DELETE_USER'").collect()}
    ev = {row.userid: row.s for row in r.events.groupBy("userid").agg(F.sum("amount").alias("s")).collect()}
    start = {row.userid: row.amount for row in opening.collect()}
    for b in r.balances.collect():
        if b.userid not in deleted:
            assert b.balance == start.get(b.userid, 0) + ev.get(b.userid, 0)
    last = {}
    for d in sorted(dec.values(), key=lambda d: (d.txn_time, d.request_id)):
        last[d.userid] = d
    held = {row.userid: row.s for row in r.usage.groupBy("userid").agg(F.sum("allocated_amount").alias("s")).collect()}
    for uid, d in last.items():
        assert (held.get(uid) or 0) == d.allocated_after
    assert r.txns.groupBy("userid", "user_txn_id").count().filter("count > 1").count() == 0


def test_strict_mode_never_overdraws(spark):
    reqs, users, opening = _log(spark, 9, negative=False, used_zero=True)
    r = D.charge(reqs, users=users, opening_events=opening, mode="strict")
    bad = r.decisions.filter((F.col("balance_after") - F.col("allocated_after")) < 0).count()
    assert bad == 0
    ref = D.charge(reqs, users=users, opening_events=opening)
    assert ref.decisions.count() == r.decisions.count()


def test_fold_does_not_depend_on_partitioning(spark):
    reqs, users, opening = _log(spark, 4)
    cols = ["request_id", "status", "status_text", "balance_after", "allocated_after"]
    a = sorted(tuple(x) for x in D.charge(reqs, users, opening, partitions=1).decisions.select(*cols).collect())
    b = sorted(tuple(x) for x in D.charge(reqs.repartition(7), users, opening, partitions=5)
               .decisions.select(*cols).collect())
    assert a == b


def test_fold_state_carries_across_arrow_batches(spark):
    """A user's rows may span many Arrow batches inside one partition; the
    state must carry over (tiny batches force a boundary every 7 rows)."""
    reqs, users, opening = _log(spark, 11, users=3)
    cols = ["request_id", "status", "status_text", "balance_after", "allocated_after"]
    want = sorted(tuple(x) for x in D.charge(reqs, users, opening, partitions=2).decisions.select(*cols).collect())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(x) for x in D.charge(reqs, users, opening, partitions=2).decisions.select(*cols).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want
