"""Map state, event-time timers and reading the state of the streaming replay."""

import pytest
from pyspark.sql import functions as F
from test_segments import BASE, log, rows_of

from tollgate import schema as S
from tollgate.operators import charge as D
from tollgate.streaming import charge_stream as CS
from tollgate.streaming import timed_charge as TC

MIN = 60_000_000


def req(i, t, uid, op="REPORT_USAGE", session=1, used=0, wanted=10, txn=None):
    return (i, BASE + t, uid, op, txn or f"T{i}", session if op == "REPORT_USAGE" else None, used, wanted, 5, None, None)


@pytest.fixture
def people(spark):
    users = spark.createDataFrame([(u,) for u in range(1, 60)], "userid long").select(
        "userid", F.lit("{}").alias("user_json_object"), F.timestamp_micros(F.lit(BASE)).alias("user_last_seen"),
        F.lit(None).cast("long").alias("user_softlock_sessionid"), F.lit(None).cast("timestamp").alias("user_softlock_expiry"))
    return users, users.select("userid", F.lit(100).cast("long").alias("amount"))


def run(spark, tmp, rows, people, **kw):
    log(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    TC.run_timed(CS.request_stream(spark, f"{tmp}/in"), f"{tmp}/out", f"{tmp}/ck", 120, users=people[0],
                 opening_events=people[1], **kw)
    return CS.read_charge_outputs(spark, f"{tmp}/out")


def test_idle_users_are_released_by_timers_over_a_restart(spark, tmp_path, people):
    """User 1 is idle after its reservation at 0; users 2 and 3 move the clock.
    The release comes as the watermark passes +180 min, in a later run."""
    out = run(spark, tmp_path, [req(0, 0, 1), req(1, 1 * MIN, 2), req(2, 100 * MIN, 2, session=2)], people)
    assert TC.releases_of(out).count() == 0
    assert TC.read_state(spark, f"{tmp_path}/ck").usage.count() == 3
    out = run(spark, tmp_path, [req(3, 200 * MIN, 3, wanted=0)], people)
    got = {(r.userid, r.session_id, r.amount, r.released_at) for r in TC.releases_of(out).collect()}
    at = lambda m: spark.range(1).select(F.timestamp_micros(F.lit(BASE + m * MIN))).first()[0]
    assert got == {(1, 1, 10, at(180)), (2, 1, 10, at(181))}
    left = TC.read_state(spark, f"{tmp_path}/ck")
    assert [(r.userid, r.sessionid) for r in left.usage.collect()] == [(2, 2)]


def test_rows_behind_the_watermark_are_kept_as_late_or_applied(spark, tmp_path, people):
    """A row behind the watermark is applied where nothing of its user was
    applied or released after it, and is late otherwise; none is lost."""
    run(spark, tmp_path, [req(0, 0, 1), req(1, 400 * MIN, 2)], people)
    out = run(spark, tmp_path, [req(2, 100 * MIN, 1, session=7), req(3, 90 * MIN, 4), req(4, 500 * MIN, 1)], people)
    assert {r.request_id for r in CS.late_of(out).collect()} == {2}
    assert {r.request_id for r in CS.decisions_of(out).collect()} == {0, 1, 3, 4}


def test_decisions_and_state_equal_the_replay(spark, tmp_path, people):
    """Gaps, retries, locks, deletes; two runs; decisions, events and the state
    read from the checkpoint equal the batch replay's."""
    from test_segments import random_log
    rows = sorted(random_log(4, list(range(1, 9)), 300), key=lambda r: (r[1], r[0]))
    half = next(i for i in range(150, 300) if rows[i][1] > rows[i - 1][1])
    run(spark, tmp_path, rows[:half], people, watermark="0 seconds")
    out = run(spark, tmp_path, rows[half:], people, watermark="0 seconds")
    want = D.charge(log(spark, rows), *people)
    assert rows_of(CS.decisions_of(out)) == rows_of(want.decisions)
    assert rows_of(CS.events_of(out)) == rows_of(want.events_with_request)
    state = TC.read_state(spark, f"{tmp_path}/ck")
    for part in ("users", "balances", "txns"):
        assert rows_of(getattr(state, part)) == rows_of(getattr(want, part)), part
    # reservations: the timers have also taken what idle users held
    end = max(r[1] for r in rows)
    young = F.unix_micros("lastdate") + F.lit(S.USAGE_TTL_MINUTES * MIN) >= F.lit(end)
    assert rows_of(state.usage.where(young)) == rows_of(want.usage.where(young))
    assert state.usage.where(F.unix_micros("lastdate") + F.lit(S.USAGE_TTL_MINUTES * MIN) < F.lit(end - 1000)).count() == 0


class FakeMap:
    def __init__(self):
        self.rows, self.written, self.removed = {}, 0, 0

    def iterator(self):
        return iter(list(self.rows.items()))

    def updateValue(self, k, v):
        self.rows[k], self.written = tuple(v), self.written + 1

    def removeKey(self, k):
        del self.rows[k]
        self.removed += 1


class FakeHandle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                return getattr(handle, "core", None)

            def update(self, v):
                handle.core = v
        return Value()

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, FakeMap())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_writes_follow_the_touched_rows():
    """A user with 50 open sessions and ledger rows: one request writes one
    reservation and one ledger row and removes two pruned ones."""
    from pyspark.sql import Row
    handle = FakeHandle()
    p = TC.TimedChargeProcessor()
    p.init(handle)
    row = Row("t_us", "request_id", "op", "txn_id", "session_id", "units_used", "units_wanted", "amount", "json", "delta_op")
    first = [row(BASE, 0, "UPSERT_USER", "C", None, None, None, 10 ** 6, "{}", None)]
    first += [row(BASE + i, i, "REPORT_USAGE", f"T{i}", i, 0, 5, None, None, None) for i in range(1, 51)]
    list(p.handleInputRows((1,), iter(first), None))
    usage, ledger = handle.maps["usage"], handle.maps["ledger"]
    assert (usage.written, ledger.written) == (50, 51) and handle.timers == {TC.timer_of(BASE + 1)}
    usage.written = ledger.written = 0
    list(p.handleInputRows((1,), iter([row(BASE + 5 * MIN, 60, "REPORT_USAGE", "N", 7, 0, 5, None, None, None)]), None))
    assert (usage.written, usage.removed, ledger.written, ledger.removed) == (1, 0, 1, 2)

