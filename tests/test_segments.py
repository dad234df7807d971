"""The replay split at idle gaps against the plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.operators import charge as D
from tollgate.operators.segments import HOUR_US, charge_by_segments, segments

BASE = 1_704_067_200_000_000
FIELDS = ("request_id long, t long, userid long, op string, txn_id string, session_id long, units_used long, "
          "units_wanted long, amount long, json string, delta_op string")


def log(spark, rows):
    return (spark.createDataFrame(rows, FIELDS).withColumn("txn_time", F.timestamp_micros("t")).drop("t")
            .select(*[f.name for f in S.REQUESTS.fields]))


def random_log(seed, users, n, hot=None):
    """Bursts of requests of all kinds, minutes to hours apart; gaps of exactly
    the TTL and one microsecond more; retries of old ids; deletes and sign-ups."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        uid = hot if hot is not None and rng.random() < 1 / 3 else rng.choice(users)
        ttl = 180 * 60_000_000
        wait = rng.choice([0, 1000, 30_000, 2_000_000, 70_000_000, 400_000_000, HOUR_US, ttl, ttl + 1, ttl + HOUR_US, 9 * HOUR_US])
        t = clock[uid] = clock.get(uid, BASE) + wait
        op = rng.choice(["REPORT_USAGE"] * 6 + ["ADD_CREDIT"] * 3 + ["LOCK_USER", "UPDATE_USER", "UPDATE_USER", "UPSERT_USER", "DELETE_USER"])
        txn = rng.choice([f"T{i}", f"T{rng.randrange(i + 1)}", f"T{i}", None if rng.random() < 0.1 else f"U{i}"])
        session = rng.choice([None, 1, 2, 3, rng.randrange(max(i, 1))])
        number = rng.random() < 0.5
        json = rng.choice(["12", "abc"]) if number else rng.choice(['{"loyaltySchemeName":"x"}', "bad", None])
        rows.append((i, t, uid, op, txn if op in ("REPORT_USAGE", "ADD_CREDIT", "UPSERT_USER") else None, session,
                     rng.randrange(20), rng.choice([0, 5, 300]), rng.randrange(-5, 60), json,
                     S.NEW_LOYALTY_NUMBER if number and op == "UPDATE_USER" else None))
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def same(a, b):
    for part in ("decisions", "events_with_request", "users", "usage", "txns", "balances"):
        x, y = rows_of(getattr(a, part)), rows_of(getattr(b, part))
        assert x == y, (part, sorted(set(x) ^ set(y), key=str)[:4])


@pytest.fixture(scope="module")
def people(spark):
    users = spark.createDataFrame([(u, "{}" if u % 2 else "bad", u) for u in range(1, 6)], "userid long, js string, lock long")
    users = users.select("userid", F.col("js").alias("user_json_object"), F.timestamp_micros(F.lit(BASE)).alias("user_last_seen"),
                         F.when(F.col("lock") == 2, F.lit(3)).cast("long").alias("user_softlock_sessionid"),
                         F.when(F.col("lock") == 2, F.timestamp_micros(F.lit(BASE + 40 * HOUR_US))).alias("user_softlock_expiry"))
    opening = spark.createDataFrame([(1, 50), (2, 400), (2, 1), (7, 9)], "userid long, amount long")    # 3 to 5 have none, 7 is unknown
    return users, opening


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs_equal_the_plain_replay(spark, people, seed):
    users, opening = people
    req = log(spark, random_log(seed, list(range(1, 10)), 700))
    same(charge_by_segments(req, users, opening), D.charge(req, users, opening))


def test_reservations_from_before_the_log_keep_segments_together(spark, people):
    """A reservation that is younger than a gap's end still counts behind it."""
    users, opening = people
    usage = spark.createDataFrame([(1, 40, 9, BASE + 30 * HOUR_US), (2, 7, 8, BASE)], "userid long, allocated_amount long, sessionid long, t long")
    usage = usage.withColumn("lastdate", F.timestamp_micros("t")).drop("t")
    txns = spark.createDataFrame([(1, "T1", BASE)], "userid long, user_txn_id string, t long").select(
        "userid", "user_txn_id", F.timestamp_micros("t").alias("txn_time"), F.lit(None).cast("long").alias("sessionid"),
        F.lit(0).cast("long").alias("approved_amount"), F.lit(0).cast("long").alias("spent_amount"), F.lit("x").alias("purpose"))
    req = log(spark, random_log(5, [1, 2, 3], 300))
    same(charge_by_segments(req, users, opening, usage, txns), D.charge(req, users, opening, usage, txns))


def test_a_hot_user_is_many_tasks(spark, people):
    """A third of the log is one user's: its segments are dealt to many tasks."""
    users, opening = people
    rows = random_log(8, list(range(10, 40)), 3000, hot=1)
    req = log(spark, rows)
    inp = D._input_rows(req, users, opening, None, None)
    found = segments(inp).where("userid = 1")
    n = found.agg(F.max("segs")).first()[0]
    assert n > 100 and sum(r[2] == 1 for r in rows) > 900
    got = charge_by_segments(req, users, opening)
    same(got, D.charge(req, users, opening))
    parts = found.select("userid", "seg").distinct().repartition(8, "userid", "seg").select(F.spark_partition_id()).distinct().count()
    assert parts == 8


def test_gap_of_exactly_the_ttl_does_not_split(spark):
    ttl = 180 * 60_000_000
    rows = [(i, t, 1, "REPORT_USAGE", f"T{i}", 1, 0, 5, None, None, None) for i, t in
            enumerate([BASE, BASE + ttl, BASE + 2 * ttl + 1, BASE + 2 * ttl + 2])]
    got = segments(D._input_rows(log(spark, rows), None, None, None, None))
    assert {(r.seg, r.segs) for r in got.collect()} == {(0, 2), (1, 2)}
    assert got.agg(F.min(F.when(F.col("seg") == 1, F.col("hour")))).first()[0] == (BASE + 2 * ttl + 1) // HOUR_US


def test_segments_plan_has_no_window_over_requests(spark, people):
    """Windows see one row per (user, hour), behind a partial aggregate."""
    req = log(spark, random_log(9, [1, 2], 50))
    plan = segments(D._input_rows(req, *people, None, None))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate") and "CartesianProduct" not in plan
    below = plan[plan.index("HashAggregate"):]
    assert "Window" not in below


def test_empty_log(spark, people):
    req = log(spark, random_log(9, [1, 2], 5)).limit(0)
    same(charge_by_segments(req, *people), D.charge(req, *people))
