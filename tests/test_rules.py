"""
on tiny literal logs through the pure-Python fold.  Each assertion fails if
its rule is inverted."""

from foldkit import MIN, SEC, T0, Log, user

from tollgate import schema as S
from tollgate.operators.fold import UserState, apply_loyalty_delta, fmt_ts


def test_q1_decision_ignores_the_spend_just_reported():
    log = Log(user(balance=100))
    d = log.usage(txn_id="a", session_id=7, units_used=90, units_wanted=50)
    assert d["status"] == S.STATUS_ALL_UNITS_ALLOCATED and d["approved"] == 50   # avail = 100, not 10
    assert d["balance_after"] == 10
    strict = Log(user(balance=100), mode="strict")
    d = strict.usage(txn_id="a", session_id=7, units_used=90, units_wanted=50)
    assert d["status"] == S.STATUS_SOME_UNITS_ALLOCATED and d["approved"] == 10


def test_q1_other_sessions_reserve_credit():
    log = Log(user(balance=100))
    log.usage(txn_id="a", session_id=1, units_used=0, units_wanted=80)
    d = log.usage(t=SEC, txn_id="b", session_id=2, units_used=0, units_wanted=50)
    assert (d["status"], d["approved"], d["allocated_after"]) == (S.STATUS_SOME_UNITS_ALLOCATED, 20, 100)
    # the same session replaces its own reservation instead
    d = log.usage(t=2 * SEC, txn_id="c", session_id=1, units_used=0, units_wanted=70)
    assert (d["status"], d["approved"]) == (S.STATUS_ALL_UNITS_ALLOCATED, 70)


def test_q2_duplicate_credit_still_adds_money():
    log = Log(user(balance=0))
    assert log.credit(txn_id="x", amount=10)["status"] == S.STATUS_CREDIT_ADDED
    d = log.credit(t=SEC, txn_id="x", amount=10)
    assert d["status"] == S.STATUS_TXN_ALREADY_HAPPENED
    assert d["balance_after"] == 20
    assert log.events[-1] == (10, "x", "Credit already added")
    strict = Log(user(balance=0), mode="strict")
    strict.credit(txn_id="x", amount=10)
    assert strict.credit(t=SEC, txn_id="x", amount=10)["balance_after"] == 10


def test_q3_reservation_row_even_when_nothing_is_granted():
    log = Log(user(balance=-5))
    d = log.usage(txn_id="a", session_id=3, units_used=0, units_wanted=10)
    assert d["status"] == S.STATUS_NO_MONEY and d["approved"] == 0
    assert d["status_text"] == "Spent 0; Negative balance: -5"
    assert log.st.usage[3][0] == 0


def test_q4_units_wanted_zero_ends_the_session():
    log = Log(user(balance=100))
    log.usage(txn_id="a", session_id=3, units_used=0, units_wanted=40)
    d = log.usage(t=SEC, txn_id="b", session_id=3, units_used=30, units_wanted=0)
    assert d["status"] == S.STATUS_OK and d["status_text"] is None
    assert d["approved"] == 0 and 3 not in log.st.usage and d["allocated_after"] == 0
    assert log.st.ledger.get("b")[4] == "Spent -30"


def test_q5_new_session_takes_the_request_id():
    log = Log(user(balance=100))
    d = log.usage(request_id=990, txn_id="a", session_id=None, units_used=0, units_wanted=5)
    assert d["session_id"] == 990 and 990 in log.st.usage


def test_q5_marker_for_no_session_is_a_new_session_in_any_batch(spark):
    import pyarrow as pa

    from tollgate.operators.charge import _pylists
    log = Log(user(balance=100))
    d = log.usage(request_id=991, txn_id="a", session_id=-(1 << 63), units_used=0, units_wanted=5)
    assert d["session_id"] == 991
    for values in ([-(1 << 63)], [-(1 << 63), None, 5]):
        batch = pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], names=["x"])
        assert _pylists(batch)["x"] == values


def test_q7_upsert_of_existing_user_only_adds_credit():
    log = Log(user(balance=5, json="old"))
    d = log("UPSERT_USER", txn_id="u", amount=7, json="new")
    assert d["status"] == S.STATUS_OK
    assert d["status_text"] == "Updated user 1 - added credit of 7; balance now 0"
    assert log.st.json == "old" and log.st.balance == 12
    assert log.events[-1] == (7, "u", "user upserted")


def test_upsert_creates_missing_user():
    log = Log(UserState(), uid=9)
    d = log("UPSERT_USER", txn_id="u", amount=0, json="{}")
    assert d["status_text"] == "Created user 9 with opening credit of 0"
    assert log.st.exists and log.st.balance == 0 and log.events == [(0, "u", "user created")]
    assert log("UPSERT_USER", t=SEC, txn_id="u", amount=3)["status"] == S.STATUS_TXN_ALREADY_HAPPENED
    assert log.st.balance == 0


def test_q9_locks():
    log = Log(user())
    first = log("LOCK_USER", request_id=101)
    assert (first["status"], first["status_text"], first["session_id"]) == (S.STATUS_RECORD_HAS_BEEN_SOFTLOCKED, "101", 101)
    held = log("LOCK_USER", t=20_000, request_id=102)
    assert held["status"] == S.STATUS_RECORD_ALREADY_SOFTLOCKED
    assert held["status_text"] == "User 1 has already been locked by session 101"
    # another session is refused even after expiry (only NULL counts as free)
    late = log("UPDATE_USER", t=90_000, session_id=-1, json="x")
    assert late["status"] == S.STATUS_RECORD_HAS_BEEN_SOFTLOCKED
    assert late["status_text"].startswith("User 1 currently locked by session 101. Expires at ")
    # ... but a new lock takes the expired one over
    assert log("LOCK_USER", t=100_000, request_id=103)["status"] == S.STATUS_RECORD_HAS_BEEN_SOFTLOCKED
    # the owner may update after expiry
    ok = log("UPDATE_USER", t=10 * SEC, session_id=103, json="new")
    assert ok["status"] == S.STATUS_OK and log.st.json == "new" and log.st.lock_expiry is None
    # unlocked: anybody may update
    assert log("UPDATE_USER", t=11 * SEC, session_id=-5, json="n2")["status"] == S.STATUS_OK


def test_loyalty_delta():
    log = Log(user(json='{"mysteriousHexPayload":"AB","loyaltySchemeName":"HelperCard","loyaltySchemeNumber":1}'))
    d = log("UPDATE_USER", session_id=1, json="42", delta_op=S.NEW_LOYALTY_NUMBER)
    assert d["status"] == S.STATUS_OK
    assert log.st.json == '{"mysteriousHexPayload":"AB","loyaltySchemeName":"HelperCard","loyaltySchemeNumber":42}'
    bad = log("UPDATE_USER", t=SEC, session_id=1, json="abc", delta_op=S.NEW_LOYALTY_NUMBER)
    assert bad["status"] == S.STATUS_ABORTED and "abc" in bad["status_text"]
    assert apply_loyalty_delta("not json", "1")[0] is None
    assert apply_loyalty_delta('{"loyaltySchemeName":null}', "5") == ('{"loyaltySchemeNumber":5}', None)


def test_q10_finite_duplicate_horizon():
    log = Log(user(balance=1000))
    log.credit(txn_id="x", amount=10)
    # within the hour the retry is detected
    assert log.credit(t=10 * MIN, txn_id="x", amount=10)["status"] == S.STATUS_TXN_ALREADY_HAPPENED
    fresh = Log(user(balance=1000))
    fresh.credit(txn_id="x", amount=10)
    # after the TTL the ledger row is gone and the retry is applied again
    assert fresh.credit(t=61 * MIN, txn_id="x", amount=10)["status"] == S.STATUS_CREDIT_ADDED
    strict = Log(user(balance=1000), mode="strict")
    strict.credit(txn_id="x", amount=10)
    assert strict.credit(t=61 * MIN, txn_id="x", amount=10)["status"] == S.STATUS_TXN_ALREADY_HAPPENED


def test_q10_report_usage_prunes_two_stale_rows():
    log = Log(user(balance=1000))
    for i in range(4):
        log.credit(t=i, txn_id=f"c{i}", amount=1)
    # credits prune only when their oldest row is 5 min old; all four are kept
    assert len(log.st.ledger.rows) == 4
    log.usage(t=2 * MIN, txn_id="r", session_id=1, units_used=0, units_wanted=1)
    assert sorted(log.st.ledger.rows) == ["c2", "c3", "r"]
    # the probe happens before the prune: a retry of c2 is still caught
    assert log.usage(t=3 * MIN, txn_id="c2", session_id=1, units_used=0, units_wanted=1)["status"] == 46
    assert sorted(log.st.ledger.rows) == ["r"]


def test_add_credit_deletes_oldest_after_five_minutes():
    log = Log(user(balance=0))
    log.credit(txn_id="a", amount=1)
    log.credit(t=4 * MIN, txn_id="b", amount=1)
    assert sorted(log.st.ledger.rows) == ["a", "b"]
    log.credit(t=6 * MIN, txn_id="c", amount=1)
    assert sorted(log.st.ledger.rows) == ["b", "c"]


def test_q13_unknown_user_changes_nothing():
    log = Log(UserState(), uid=5)
    for op in ("REPORT_USAGE", "ADD_CREDIT", "LOCK_USER", "UPDATE_USER"):
        d = log(op, txn_id="t", units_wanted=1, amount=1, session_id=1)
        assert d["status"] == S.STATUS_USER_DOESNT_EXIST
    assert log.events == [] and log.st.balance is None and not log.st.ledger.rows
    assert log.out.d["status_text"][1] == "User ID 5 does not exist"


def test_q14_negative_amounts_are_accepted():
    log = Log(user(balance=10))
    assert log.credit(txn_id="n", amount=-50)["balance_after"] == -40
    d = log.usage(t=SEC, txn_id="u", session_id=1, units_used=-5, units_wanted=3)
    assert d["spent"] == 5 and d["status"] == S.STATUS_NO_MONEY


def test_q18_delete_keeps_exported_events():
    log = Log(user(balance=10))
    log.credit(txn_id="a", amount=5)
    d = log("DELETE_USER", t=SEC)
    assert d["status"] == S.STATUS_OK and d["balance_after"] is None
    assert log.events == [(5, "a", "Added 5")]
    assert log.credit(t=2 * SEC, txn_id="b", amount=5)["status"] == S.STATUS_USER_DOESNT_EXIST
    # a later upsert starts fresh and may reuse an old txn id
    d = log("UPSERT_USER", t=3 * SEC, txn_id="a", amount=1, json="{}")
    assert d["status"] == S.STATUS_OK and d["balance_after"] == 1


def test_missing_balance_row_aborts_without_side_effects():
    st = user(balance=None)
    st.ledger.insert("old", T0, None, 0, 1, "x")
    log = Log(st)
    d = log.usage(t=10 * MIN, txn_id="a", session_id=1, units_used=5, units_wanted=5)
    assert d["status"] == S.STATUS_ABORTED
    assert "old" in log.st.ledger.rows and log.events == [] and log.st.balance is None
    # ending a session needs no balance read, so it goes through
    assert log.usage(t=11 * MIN, txn_id="b", session_id=1, units_used=5, units_wanted=0)["status"] == S.STATUS_OK
    assert log.st.balance == -5


def test_reservation_ttl_releases_credit():
    log = Log(user(balance=100))
    log.usage(txn_id="a", session_id=1, units_used=0, units_wanted=100)
    assert log.credit(t=179 * MIN, txn_id="c", amount=0)["allocated_after"] == 100
    assert log.credit(t=181 * MIN, txn_id="d", amount=0)["allocated_after"] == 0


def test_every_status_code_and_text():
    log = Log(user(balance=10))
    seen = {log.usage(txn_id="a", session_id=1, units_used=0, units_wanted=5)["status"],
            log.usage(t=1, txn_id="b", session_id=2, units_used=0, units_wanted=50)["status"],
            log.usage(t=2, txn_id="b", session_id=2, units_used=0, units_wanted=50)["status"],
            log.usage(t=3, txn_id="c", session_id=3, units_used=100, units_wanted=0)["status"],
            log.usage(t=4, txn_id="d", session_id=4, units_used=0, units_wanted=1)["status"],
            log.credit(t=5, txn_id="e", amount=1)["status"],
            log("LOCK_USER", t=6)["status"], log("LOCK_USER", t=7)["status"]}
    assert seen == {42, 43, 44, 45, 46, 53, 54, 56}
    assert log.out.d["status_text"][1] == "Spent 0; Allocated 5 units of 50 asked for"
    assert log.out.d["status_text"][0] == "Spent 0; Allocated 5"
    assert log.out.d["status_text"][2] == "Event already happened at " + fmt_ts(1_704_067_200_000_001)
    assert log.out.d["status_text"][5] == "1 added by Txn e"


def test_state_round_trip():
    log = Log(user(balance=10))
    log.usage(txn_id="a", session_id=1, units_used=1, units_wanted=2)
    log("LOCK_USER", t=5)
    again = UserState.from_json(log.st.to_json())
    assert again.to_json() == log.st.to_json()
    assert again.alloc == log.st.alloc and again.ledger.oldest() == log.st.ledger.oldest()


def test_missing_txn_id_aborts_like_a_not_null_violation():
    log = Log(user(balance=10))
    log.credit(txn_id="a", amount=5)
    for op in ("REPORT_USAGE", "ADD_CREDIT", "UPSERT_USER"):
        d = log(op, t=SEC, txn_id=None, session_id=1, units_used=3, units_wanted=2, amount=4)
        assert d["status"] == S.STATUS_ABORTED and d["balance_after"] == 15
    assert log.events == [(5, "a", "Added 5")] and sorted(log.st.ledger.rows) == ["a"]
    missing = Log(UserState(), uid=3)
    assert missing.usage(txn_id=None, units_wanted=1)["status"] == S.STATUS_USER_DOESNT_EXIST
