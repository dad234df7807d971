"""Point, list and range forms of the lookups, deletes and user view, which
the registered (bulk) queries do not exercise."""

import datetime as dt

from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.operators import charge as D
from tollgate.operators import latency as H
from tollgate.operators import lookups as L
from tollgate.operators import maintenance as R

T0 = dt.datetime(2024, 1, 1)
J = '{"mysteriousHexPayload":"%d","loyaltySchemeName":"HelperCard","loyaltySchemeNumber":%d}'


def _users(spark):
    return spark.createDataFrame([(u, J % (u, u % 3), T0, None, None) for u in range(1, 7)], S.USERS)


def test_point_and_list_lookups(spark):
    users = _users(spark)
    assert L.user_by_id(users, 3).count() == 1
    assert L.user_by_id(users, [1, 2, 99]).count() == 2
    assert sorted(r.userid for r in L.find_by_loyalty_card(users, 0).collect()) == [3, 6]
    assert sorted(r.userid for r in L.find_by_loyalty_card(users, [1, 2]).collect()) == [1, 2, 4, 5]
    txns = spark.createDataFrame([(1, "b", T0, None, 0, 1, "x"), (1, "a", T0, None, 0, 1, "x"),
                                  (2, "c", T0, None, 0, 1, "x")], S.TXNS)
    assert [r.user_txn_id for r in L.show_transactions(txns, 1).collect()] == ["a", "b"]
    assert L.duplicates_of_ledger(
        spark.createDataFrame([(1, "a"), (1, "z")], "userid long, txn_id string"), txns).count() == 1


def test_delete_users_by_list_range_and_frame(spark):
    users = _users(spark)
    ev = spark.createDataFrame([(u, 5, f"t{u}", "m", T0) for u in range(1, 7)], S.FIN_EVENTS)
    state = {"users": users, "fin_events": ev}
    assert R.delete_users(state, ids=[1, 2])["users"].count() == 4
    assert R.delete_users(state, id_range=(2, 5))["users"].count() == 2
    ids = spark.createDataFrame([(6,)], "userid long")
    out = R.delete_users(state, ids=ids)
    assert out["users"].count() == 5 and out["fin_events"].count() == 6      # exported events stay (Q18)


def test_user_360_detail_and_set_counters(spark):
    users = _users(spark)
    usage = spark.createDataFrame([(1, 5, 10, T0), (1, 7, 11, T0), (2, 1, 20, T0)], S.USAGE)
    ev = spark.createDataFrame([(1, 100, "a", "m", T0), (1, -5, "b", "m", T0)], S.FIN_EVENTS)
    txns = spark.createDataFrame([(1, "a", T0, None, 0, 100, "x")], S.TXNS)
    d = D.user_360_detail(users, usage, ev, txns, [1])
    assert d["user"].count() == 1 and d["usage"].count() == 2
    assert d["balance"].first().balance == 95 and d["txns"].count() == 1
    old = spark.createDataFrame([("a", 5)], "type string, counter long")
    new = spark.createDataFrame([("a", 9), ("b", 2)], "type string, counter long")
    assert {r.type: r.counter for r in H.set_counters(old, new).collect()} == {"a": 5, "b": 2}


def test_charge_with_initial_ledger_and_reservations(spark):
    """Initial ledger rows make a retry a duplicate; initial reservations count
    against the next grant."""
    users = _users(spark).filter("userid = 1")
    opening = spark.createDataFrame([(1, 100)], "userid long, amount long")
    usage = spark.createDataFrame([(1, 60, 7, T0)], S.USAGE)
    txns = spark.createDataFrame([(1, "old", T0, None, 0, 5, "Add Credit")], S.TXNS)
    reqs = spark.createDataFrame(
        [(1, T0 + dt.timedelta(seconds=30), 1, "ADD_CREDIT", "old", None, None, None, 5, None, None),
         (2, T0 + dt.timedelta(seconds=40), 1, "REPORT_USAGE", "r", 8, 0, 70, None, None, None)], S.REQUESTS)
    r = D.charge(reqs, users=users, opening_events=opening, usage=usage, txns=txns)
    got = {x.request_id: (x.status, x.approved, x.allocated_after) for x in r.decisions.collect()}
    assert got[1][0] == S.STATUS_TXN_ALREADY_HAPPENED
    assert got[2] == (S.STATUS_SOME_UNITS_ALLOCATED, 45, 105)        # 100 + 5 (Q2) - 60 held by session 7
    assert {(x.sessionid, x.allocated_amount) for x in r.usage.collect()} == {(7, 60), (8, 45)}
    assert r.users.filter(F.col("userid") == 1).count() == 1


def test_replay_saved_once_and_read_back(spark, tmp_path):
    from tollgate.sources import fixtures as fx
    from conftest import SF_SMALL
    r = D.charge(fx.requests(spark, SF_SMALL), fx.users(spark, SF_SMALL), fx.opening_events(spark, SF_SMALL))
    r.save(str(tmp_path / "replay"))
    back = D.ChargeResult.load(spark, str(tmp_path / "replay"))
    assert back.decisions.count() == r.decisions.count() and back.txns.count() == r.txns.count()
    plan = back.events._jdf.queryExecution().executedPlan().toString()
    assert "kind=event" in plan or "PartitionFilters: [isnotnull(kind" in plan


def test_loyalty_delta_column_form_agrees_with_the_fold(spark):
    """F8 as a Spark column (from_json/withField/to_json) and as the fold's
    Python function give the same JSON or the same refusal."""
    from tollgate.functions.columns import loyalty_delta_update
    from tollgate.operators.fold import apply_loyalty_delta
    old = J % (7, 1)
    payloads = ["42", "+9", "-0", "-17", "007", " 12", "12 ", "1.5", "", "abc", "9223372036854775807",
                "9223372036854775808", "-9223372036854775808", "99999999999999999999"]
    olds = [old, '{"loyaltySchemeName":"X"}', '{"mysteriousHexPayload":"A","extra":1}', "[1,2]", "not json"]
    rows = [(i, o, p) for i, (o, p) in enumerate((o, p) for o in olds for p in payloads)]
    df = spark.createDataFrame(rows, "i long, old string, payload string")
    got = {r.i: r.new for r in df.select("i", loyalty_delta_update("old", "payload").alias("new")).collect()}
    for i, o, p in rows:
        want = apply_loyalty_delta(o, p)[0]
        assert got[i] == want, (o, p, got[i], want)


def test_credit_and_upsert_closed_forms_equal_the_fold_inside_the_horizon(spark):
    """Within four minutes nothing is pruned or expired, so the closed forms
    (infinite horizon, static users) must give the fold's decisions."""
    base = T0 + dt.timedelta(hours=1)
    rows = []
    for i, (uid, op, txn, amt) in enumerate([
            (1, "ADD_CREDIT", "a", 5), (1, "ADD_CREDIT", "a", 5), (1, "ADD_CREDIT", None, 7),
            (2, "ADD_CREDIT", "b", 1), (9, "ADD_CREDIT", "c", 3), (1, "ADD_CREDIT", "d", -2),
            (3, "UPSERT_USER", "u", 4), (3, "UPSERT_USER", "u", 4), (3, "UPSERT_USER", "v", 1),
            (8, "UPSERT_USER", "w", 2), (8, "UPSERT_USER", "x", 6), (8, "UPSERT_USER", None, 6)]):
        rows.append((i, base + dt.timedelta(seconds=10 * i), uid, op, txn, None, None, None, amt, "{}", None))
    reqs = spark.createDataFrame(rows, S.REQUESTS)
    users = _users(spark).filter("userid <= 3")
    opening = spark.createDataFrame([(u, 10) for u in (1, 2, 3)], "userid long, amount long")
    fold = {r.request_id: (r.status, r.status_text)
            for r in D.charge(reqs, users=users, opening_events=opening).decisions.collect()}
    d4 = {r.request_id: (r.status, r.status_text) for r in D.add_credit(reqs, users)[0].collect()}
    d5 = {r.request_id: (r.status, r.status_text) for r in D.upsert_user(reqs, users)[0].collect()}
    assert d4 == {k: v for k, v in fold.items() if k < 6}
    assert d5 == {k: v for k, v in fold.items() if k >= 6}
    assert {s for s, _ in fold.values()} >= {-1, 42, 46, 50, 56}


def test_replay_of_a_log_without_optional_columns(spark):
    """A credit-only log without session, unit, JSON or delta columns."""
    reqs = spark.createDataFrame([(1, T0, 1, "ADD_CREDIT", "a", 5), (2, T0 + dt.timedelta(seconds=1), 1,
                                   "ADD_CREDIT", "a", 5)],
                                 "request_id long, txn_time timestamp, userid long, op string, txn_id string, "
                                 "amount long")
    r = D.charge(reqs, users=_users(spark).filter("userid = 1"))
    assert [x.status for x in r.decisions.orderBy("request_id").collect()] == [56, 46]
