"""Lock and update decisions by windows against the replay."""

import random

import pytest
from pyspark.sql import functions as F
from test_segments import BASE, log, random_log

from tollgate.operators import charge as D
from tollgate.operators.audit import lock_contention
from tollgate.operators.locks import carry, lock_decisions

COLS = ("request_id", "userid", "txn_time", "op", "status", "status_text", "session_id")


def lock_log(seed, users, n, hot=None, bad=0.15):
    """Lock and update requests milliseconds apart, owners and others, sessions of
    grants long gone, deletes, sign-ups, bad numbers and bad JSON."""
    rng = random.Random(seed)
    rows, clock, seen = [], {}, {}
    for i in range(n):
        uid = hot if hot is not None and rng.random() < 0.4 else rng.choice(users)
        t = clock[uid] = clock.get(uid, BASE) + rng.choice([0, 0, 1000, 7000, 20_000, 49_999, 50_000, 50_001, 400_000, 90_000_000])
        op = rng.choice(["LOCK_USER"] * 8 + ["UPDATE_USER"] * 8 + ["UPSERT_USER"] + (["DELETE_USER"] if rng.random() < 0.4 else []))
        mine = seen.setdefault(uid, [3])
        session = rng.choice([mine[-1], mine[-1], rng.choice(mine[-4:]), rng.choice(mine), None, i])
        if op == "LOCK_USER":
            mine.append(i)
        number = rng.random() < 0.5
        json = rng.choice(["12", "-4", "1 2"]) if number else ("bad" if rng.random() < bad else '{"loyaltySchemeName":"x"}')
        rows.append((i, t, uid, op, f"T{i}" if op == "UPSERT_USER" and rng.random() < 0.9 else None, session, 0, 0, 1, json,
                     "NEW_LOYALTY_NUMBER" if number and op == "UPDATE_USER" else None))
    return rows


@pytest.fixture(scope="module")
def people(spark):
    """1 to 5 are there; 2 and 3 hold a lock from before, 3's without a session, 5's is long expired."""
    users = spark.createDataFrame(
        [(1, "{}", None, None), (2, "bad", 3, BASE + 120_000), (3, None, None, BASE + 95_000_000), (4, "{}", 3, None),
         (5, "{}", 3, BASE - 10)], "userid long, user_json_object string, user_softlock_sessionid long, e long")
    return users.select("userid", "user_json_object", F.timestamp_micros(F.lit(BASE)).alias("user_last_seen"),
                        "user_softlock_sessionid", F.timestamp_micros("e").alias("user_softlock_expiry"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(requests, users):
    want = D.charge(requests, users).decisions.where(F.col("op").isin("LOCK_USER", "UPDATE_USER")).select(*COLS)
    got = lock_decisions(requests, users)
    x, y = rows_of(got.select(*COLS)), rows_of(want)
    assert x == y, sorted(set(x) ^ set(y), key=str)[:6]
    return got, want


@pytest.mark.parametrize("seed,bad", [(1, 0.0), (2, 0.15), (3, 0.5)])
def test_random_logs_equal_the_replay(spark, people, seed, bad):
    req = log(spark, lock_log(seed, list(range(1, 9)), 900, bad=bad))
    got, want = same(req, people)
    assert got.select("op", "status").distinct().count() >= 6
    assert rows_of(lock_contention(got, req)) == rows_of(lock_contention(want, req))


def test_log_of_all_kinds_equals_the_replay(spark, people):
    same(log(spark, random_log(4, list(range(1, 9)), 600)), people)


def test_one_island_of_a_hot_user(spark, people):
    """Requests of one user, never 50 ms apart: one long chain of grants."""
    rng = random.Random(5)
    rows, t = [], BASE
    for i in range(1200):
        t += rng.choice([1000, 9000, 30_000])
        lock = rng.random() < 0.6
        rows.append((i, t, 1, "LOCK_USER" if lock else "UPDATE_USER", None, rng.randrange(max(i - 6, 0), i + 1), 0, 0, 0,
                     '{"a":1}', None))
    same(log(spark, rows), people)


def test_no_users_no_rows(spark, people):
    req = log(spark, lock_log(6, [1, 2], 40))
    same(req, None)
    assert lock_decisions(req.limit(0), people).count() == 0


def test_carry_looks_over_minutes_and_both_ways(spark):
    rows = spark.createDataFrame([(1, m * 60_000_000, m, "x" if m in (0, 3) else None) for m in range(6)],
                                 "userid long, t long, id long, v string")
    at = F.when(F.col("v").isNotNull(), F.col("id"))
    before = {r.id: r.p for r in carry(rows, {"p": at}).collect()}
    assert before == {0: None, 1: 0, 2: 0, 3: 0, 4: 3, 5: 3}
    after = {r.id: r.p for r in carry(rows, {"p": at}, after=True).collect()}
    assert after == {0: 3, 1: 3, 2: 3, 3: None, 4: None, 5: None}


def test_no_python_and_no_window_of_a_whole_user(spark, people):
    from tollgate.operators import locks as L
    req = log(spark, lock_log(7, [1, 2], 60))
    plan = L._rows(req, people)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan
    decided = L._decide(L._rows(req, people), L._grants(L._holders(L._rows(req, people)), L._rows(req, people)))
    assert "Python" not in decided._jdf.queryExecution().toString()
