"""Streams over pages of users: initial rows are stored as texts of many users,
a user gets an entry with its first request, and nobody's opening is lost."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_segments import BASE, log

from tollgate.streaming import charge_stream as CS
from tollgate.streaming import timed_charge as TC

MIN = 60_000_000


class FakeMap:
    def __init__(self):
        self.rows, self.written = {}, 0

    def iterator(self):
        return iter(list(self.rows.items()))

    def getValue(self, k):
        return self.rows.get(k)

    def updateValue(self, k, v):
        self.rows[k], self.written = tuple(v), self.written + 1


class FakeHandle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, FakeMap())


def people(spark, n):
    users = spark.range(1, n + 1).select(
        F.col("id").alias("userid"), F.lit("{}").alias("user_json_object"), F.timestamp_micros(F.lit(BASE)).alias("user_last_seen"),
        F.lit(None).cast("long").alias("user_softlock_sessionid"), F.lit(None).cast("timestamp").alias("user_softlock_expiry"))
    return users, users.select("userid", (F.col("userid") * 10).alias("amount"))


def req(i, t, uid, op="REPORT_USAGE", session=1, used=0, wanted=10):
    return (i, BASE + t, uid, op, f"T{i}", session if op == "REPORT_USAGE" else None, used, wanted, 5, None, None)


def test_initial_rows_cost_a_store_call_a_part_and_requests_one_a_user(spark):
    packed = CS.packed_opening(*people(spark, 1000), None, None, pages=2).collect()
    assert len(packed) <= 2 * CS.PARTS
    assert sorted(u for r in packed for u in CS.opening_by_user(r["rows"])) == list(range(1, 1001))
    page = next(r.page for r in packed if 7 in CS.opening_by_user(r["rows"]))
    p, handle = CS.ChargeRowProcessor(), FakeHandle()
    p.init(handle)
    for r in packed:
        if r.page == page:
            p.handleInitialState((page,), r, None)
    assert handle.maps["opening"].written <= CS.PARTS and handle.maps["users"].written == 0
    one = {"userid": 7, "t_us": BASE, "request_id": 1, "op": "REPORT_USAGE", "txn_id": "T", "units_used": 3, "units_wanted": 4}
    got = list(p.handleInputRows((page,), iter([Row("page", "request")(page, json.dumps(one))]), None))
    assert handle.maps["users"].written == 1 and handle.maps["opening"].written <= CS.PARTS
    assert [(k, u, b) for r in got for k, u, b in zip(r.kind, r.userid, r.balance_after)] == [("decision", 7, 67), ("event", 7, None)]


def test_many_output_rows_come_in_pieces(spark):
    rows = [CS.packed_row("late", {"userid": i, "request_id": i}) for i in range(2 * CS.PACKED_ROWS + 1)]
    pieces = list(CS.packed(rows))
    assert [len(p.kind) for p in pieces] == [CS.PACKED_ROWS, CS.PACKED_ROWS, 1]
    out = CS.unpacked(spark.createDataFrame(pieces[-1:], CS.PACKED_SCHEMA))
    assert out.schema.names == CS.OUT_COLS and [(r.kind, r.userid) for r in out.collect()] == [("late", 2 * CS.PACKED_ROWS)]


@pytest.mark.parametrize("pages", [1, 64])
def test_untouched_users_stay_as_they_opened(spark, tmp_path, pages):
    """User 1 is idle with a reservation from before the stream, 2 has a ledger row, 3 a
    request, 4 neither; 5 has a balance only; they share a page or not."""
    users, opening = people(spark, 4)
    opening = opening.unionByName(spark.createDataFrame([(5, 99)], "userid long, amount long"))
    at = lambda m: F.timestamp_micros(F.lit(BASE + m * MIN))
    one = spark.range(1)
    usage = one.select(F.lit(1).cast("long").alias("userid"), F.lit(6).cast("long").alias("allocated_amount"),
                       F.lit(11).cast("long").alias("sessionid"), at(0).alias("lastdate"))
    txns = one.select(F.lit(2).cast("long").alias("userid"), F.lit("A").alias("user_txn_id"), at(0).alias("txn_time"),
                      F.lit(None).cast("long").alias("sessionid"), F.lit(0).cast("long").alias("approved_amount"),
                      F.lit(3).cast("long").alias("spent_amount"), F.lit("p").alias("purpose"))
    for rows in ([req(0, 0, 3)], [req(1, 400 * MIN, 3, used=4, wanted=0)]):
        log(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        TC.run_timed(CS.request_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", 120, users=users,
                     opening_events=opening, usage=usage, txns=txns, pages=pages)
    out = CS.read_charge_outputs(spark, f"{tmp_path}/out")
    assert {(r.userid, r.session_id, r.amount) for r in TC.releases_of(out).collect()} == {(1, 11, 6), (3, 1, 10)}
    state = TC.read_state(spark, f"{tmp_path}/ck")
    assert sorted(r.userid for r in state.users.collect()) == [1, 2, 3, 4]
    assert {(r.userid, r.balance) for r in state.balances.collect()} == {(1, 10), (2, 20), (3, 26), (4, 40), (5, 99)}
    assert state.usage.count() == 0
    assert [(r.userid, r.user_txn_id) for r in sorted(state.txns.collect(), key=lambda r: r.userid)] == [(2, "A"), (3, "T1")]

