"""The charging rules as a DuckDB recursive CTE: the oracle of the replay.

Requests are numbered per user (``n``); the recursive term joins each user's
state after step ``n`` to request ``n + 1`` and computes the next state and
the step's decision and event.  State: exists, json, lock session/expiry,
balance, reservations ``us`` (list of (d = lastdate, s = session, a =
amount)) and the ledger ``tx`` (list of (t, k = txn id), kept sorted).
Independent of the Python fold: written from the rules, not from its code.
"""

from __future__ import annotations

from tollgate import schema as S
from tollgate.functions.texts import text_sql

TTL_USAGE = 180 * 60 * 1000000
TTL_TXN = 3600 * 1000000
PRUNE_TWO = 60 * 1000000
PRUNE_OLDEST = 300 * 1000000
LOCK_US = 50 * 1000

_US_T = "STRUCT(d BIGINT, s BIGINT, a BIGINT)[]"
_TX_T = "STRUCT(t BIGINT, k VARCHAR)[]"


def _ts(expr: str) -> str:
    return f"strftime(make_timestamp({expr}), '%Y-%m-%d %H:%M:%S.%f')"


def fold_ctes(requests: str = "requests", users: str = "users", opening: str = "opening_events") -> dict[str, str]:
    """CTEs (in order) ending with ``steps``: one row per applied request with
    its decision columns and optional event (ev_amount, ev_msg)."""
    req = f"""
  SELECT r.*, epoch_us(txn_time) AS t,
         row_number() OVER (PARTITION BY userid ORDER BY txn_time, request_id) AS n
  FROM {requests} r"""
    init = f"""
  SELECT k.userid, CAST(0 AS BIGINT) AS n, u.userid IS NOT NULL AS ex, u.user_json_object AS js,
         u.user_softlock_sessionid AS ls, epoch_us(u.user_softlock_expiry) AS le,
         CAST(b.bal AS BIGINT) AS bal, CAST([] AS {_US_T}) AS us, CAST([] AS {_TX_T}) AS tx,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS op,
         CAST(NULL AS INTEGER) AS status, CAST(NULL AS VARCHAR) AS status_text, CAST(NULL AS BIGINT) AS session_id,
         CAST(NULL AS BIGINT) AS approved, CAST(NULL AS BIGINT) AS spent,
         CAST(NULL AS BIGINT) AS ev_amount, CAST(NULL AS VARCHAR) AS ev_msg, CAST(NULL AS VARCHAR) AS ev_txn
  FROM (SELECT DISTINCT userid FROM {requests}) k
  LEFT JOIN {users} u USING (userid)
  LEFT JOIN (SELECT userid, sum(amount) AS bal FROM {opening} GROUP BY userid) b USING (userid)"""

    # stage 1: join state to the next request, apply the TTLs
    s1 = f"""
      SELECT s.userid, r.n, r.request_id, r.t, r.op, r.txn_id, r.session_id AS rsess, r.json AS rjson, r.delta_op,
             coalesce(r.units_wanted, 0) AS wanted, -coalesce(r.units_used, 0) AS used_neg,
             coalesce(r.amount, 0) AS amt,
             s.ex AS ex0, s.js AS js0, s.ls AS ls0, s.le AS le0, s.bal AS bal0,
             list_filter(s.us, lambda x: x.d >= r.t - {TTL_USAGE}) AS us1,
             list_filter(s.tx, lambda x: x.t >= r.t - {TTL_TXN}) AS tx1
      FROM steps s JOIN req r ON r.userid = s.userid AND r.n = s.n + 1"""
    # stage 2: reads every rule needs
    s2 = f"""
      SELECT *,
             struct_extract(list_filter(tx1, lambda x: x.k = txn_id)[1], 't') AS dup_t,
             len(list_filter(tx1, lambda x: x.t < t - {PRUNE_TWO})) AS n_stale,
             tx1[1] AS oldest,
             coalesce(rsess, request_id) AS sess,
             regexp_full_match(coalesce(rjson, ''), '[+-]?[0-9]+') AND TRY_CAST(rjson AS BIGINT) IS NOT NULL AS num_ok,
             CASE WHEN coalesce(json_valid(js0), false) THEN json_type(js0) = 'OBJECT' ELSE false END AS js_ok
      FROM ({s1})"""
    s3 = """
      SELECT *,
             list_filter(us1, lambda x: x.s <> sess) AS us2,
             CAST(coalesce(list_sum(list_transform(list_filter(us1, lambda x: x.s <> sess), lambda x: x.a)), 0) AS BIGINT) AS alloc2,
             tx1[least(2, n_stale) + 1:] AS tx_pruned
      FROM ({s2})""".format(s2=s2)
    # stage 4: status per operation
    s4 = """
      SELECT *,
        CASE op
          WHEN 'REPORT_USAGE' THEN
            CASE WHEN NOT ex0 THEN 50 WHEN txn_id IS NULL THEN -1 WHEN dup_t IS NOT NULL THEN 46
                 WHEN wanted <> 0 AND bal0 IS NULL THEN -1 WHEN wanted = 0 THEN 42
                 WHEN bal0 - alloc2 < 0 THEN 43 WHEN wanted > bal0 - alloc2 THEN 44 ELSE 45 END
          WHEN 'ADD_CREDIT' THEN CASE WHEN NOT ex0 THEN 50 WHEN txn_id IS NULL THEN -1
                                      WHEN dup_t IS NOT NULL THEN 46 ELSE 56 END
          WHEN 'UPSERT_USER' THEN CASE WHEN txn_id IS NULL THEN -1 WHEN dup_t IS NOT NULL THEN 46 ELSE 42 END
          WHEN 'LOCK_USER' THEN CASE WHEN NOT ex0 THEN 50 WHEN le0 IS NOT NULL AND le0 > t THEN 53 ELSE 54 END
          WHEN 'UPDATE_USER' THEN
            CASE WHEN NOT ex0 THEN 50
                 WHEN NOT (le0 IS NULL OR coalesce(ls0 = rsess, false)) THEN 54
                 WHEN delta_op = 'NEW_LOYALTY_NUMBER' AND NOT (js_ok AND num_ok) THEN -1
                 ELSE 42 END
          WHEN 'DELETE_USER' THEN 42
          ELSE -1 END AS st,
        bal0 - alloc2 AS avail
      FROM ({s3})""".format(s3=s3)
    # stage 5: granted amount and the ledger row written, if any
    s5 = """
      SELECT *,
        CASE WHEN op = 'REPORT_USAGE' AND st IN (42, 43) THEN 0
             WHEN op = 'REPORT_USAGE' AND st = 44 THEN avail
             WHEN op = 'REPORT_USAGE' AND st = 45 THEN wanted
             WHEN op IN ('ADD_CREDIT', 'UPSERT_USER') AND st IN (42, 56) THEN 0 END AS appr,
        CASE WHEN op = 'REPORT_USAGE' AND st BETWEEN 42 AND 45 THEN used_neg
             WHEN op IN ('ADD_CREDIT', 'UPSERT_USER') AND st IN (42, 56) THEN amt END AS moved
      FROM ({s4})""".format(s4=s4)
    ts_dup = _ts("dup_t")
    ts_le = _ts("le0")
    q = lambda v: "'" + v.replace("'", "''") + "'"
    t_missing = text_sql(S.TEXT_USER_MISSING, userid="userid")
    t_id_missing = text_sql(S.TEXT_USER_ID_MISSING, userid="userid")
    t_dup = text_sql(S.TEXT_ALREADY_HAPPENED, time=ts_dup)
    t_nobal = text_sql(S.TEXT_NO_BALANCE, userid="userid")
    t_notxn = text_sql(S.TEXT_NO_TXN_ID, userid="userid")
    t_spent = text_sql(S.TEXT_SPENT, spent="used_neg")
    t_neg = text_sql(S.TEXT_NEGATIVE_BALANCE, avail="avail")
    t_some = text_sql(S.TEXT_SOME_ALLOCATED, avail="avail", wanted="wanted")
    t_all = text_sql(S.TEXT_ALL_ALLOCATED, wanted="wanted")
    t_added = text_sql(S.TEXT_CREDIT_ADDED, amount="amt", txn_id="txn_id")
    t_created = text_sql(S.TEXT_USER_CREATED, userid="userid", amount="amt")
    t_upserted = text_sql(S.TEXT_USER_UPSERTED, userid="userid", amount="amt")
    t_locked = text_sql(S.TEXT_ALREADY_LOCKED, userid="userid", session="ls0")
    t_current = text_sql(S.TEXT_CURRENTLY_LOCKED, userid="userid", session="ls0", expiry=ts_le)
    t_badjson = text_sql(S.TEXT_BAD_JSON, userid="userid", old="coalesce(js0, 'null')", payload="coalesce(rjson, 'null')")
    t_badnum = text_sql(S.TEXT_BAD_NUMBER, payload="coalesce(rjson, 'null')")
    t_updated = text_sql(S.TEXT_USER_UPDATED, userid="userid")
    m_already = q(S.MSG_CREDIT_ALREADY_ADDED)
    m_added = text_sql(S.MSG_ADDED, amount="amt")
    m_created = q(S.MSG_USER_CREATED)
    m_upserted = q(S.MSG_USER_UPSERTED)
    new_json = ("'{' || concat_ws(',', "
                "CASE WHEN json_extract_string(CASE WHEN js_ok THEN js0 END, '$.mysteriousHexPayload') IS NOT NULL THEN "
                "'\"mysteriousHexPayload\":' || to_json(json_extract_string(CASE WHEN js_ok THEN js0 END, '$.mysteriousHexPayload')) END, "
                "CASE WHEN json_extract_string(CASE WHEN js_ok THEN js0 END, '$.loyaltySchemeName') IS NOT NULL THEN "
                "'\"loyaltySchemeName\":' || to_json(json_extract_string(CASE WHEN js_ok THEN js0 END, '$.loyaltySchemeName')) END, "
                "'\"loyaltySchemeNumber\":' || CAST(TRY_CAST(rjson AS BIGINT) AS VARCHAR)) || '}'")
    rec = f"""
  SELECT userid, n,
    CASE WHEN op = 'DELETE_USER' THEN false WHEN op = 'UPSERT_USER' AND st = 42 THEN true ELSE ex0 END AS ex,
    CASE WHEN op = 'DELETE_USER' THEN NULL
         WHEN op = 'UPSERT_USER' AND st = 42 AND NOT ex0 THEN rjson
         WHEN op = 'UPDATE_USER' AND st = 42 THEN
              CASE WHEN delta_op = 'NEW_LOYALTY_NUMBER' THEN {new_json} ELSE rjson END
         ELSE js0 END AS js,
    CASE WHEN op = 'DELETE_USER' OR (op = 'UPDATE_USER' AND st = 42) OR (op = 'UPSERT_USER' AND st = 42 AND NOT ex0)
           THEN NULL WHEN op = 'LOCK_USER' AND st = 54 THEN request_id ELSE ls0 END AS ls,
    CASE WHEN op = 'DELETE_USER' OR (op = 'UPDATE_USER' AND st = 42) OR (op = 'UPSERT_USER' AND st = 42 AND NOT ex0)
           THEN NULL WHEN op = 'LOCK_USER' AND st = 54 THEN t + {LOCK_US} ELSE le0 END AS le,
    CASE WHEN op = 'DELETE_USER' THEN NULL
         WHEN op = 'REPORT_USAGE' AND st BETWEEN 42 AND 45 AND used_neg <> 0 THEN CAST(coalesce(bal0, 0) + used_neg AS BIGINT)
         WHEN op = 'ADD_CREDIT' AND st IN (46, 56) THEN coalesce(bal0, 0) + amt
         WHEN op = 'UPSERT_USER' AND st = 42 THEN coalesce(bal0, 0) + amt
         ELSE bal0 END AS bal,
    CASE WHEN op = 'DELETE_USER' THEN CAST([] AS {_US_T})
         WHEN op = 'REPORT_USAGE' AND st = 42 THEN us2
         WHEN op = 'REPORT_USAGE' AND st BETWEEN 43 AND 45 THEN list_append(us2, {{'d': t, 's': sess, 'a': CAST(appr AS BIGINT)}})
         ELSE us1 END AS us,
    CASE WHEN op = 'DELETE_USER' THEN CAST([] AS {_TX_T})
         WHEN op = 'REPORT_USAGE' AND st = 46 THEN tx_pruned
         WHEN op = 'REPORT_USAGE' AND st BETWEEN 42 AND 45
           THEN list_sort(list_append(tx_pruned, {{'t': t, 'k': txn_id}}))
         WHEN op = 'ADD_CREDIT' AND st IN (46, 56)
           THEN list_filter(CASE WHEN st = 56 THEN list_sort(list_append(tx1, {{'t': t, 'k': txn_id}})) ELSE tx1 END,
                            lambda x: NOT coalesce(x.k = oldest.k AND oldest.t < t - {PRUNE_OLDEST}, false))
         WHEN op = 'UPSERT_USER' AND st = 42 THEN list_sort(list_append(tx1, {{'t': t, 'k': txn_id}}))
         ELSE tx1 END AS tx,
    request_id, t, op, CAST(st AS INTEGER) AS status,
    CASE op
      WHEN 'REPORT_USAGE' THEN
        CASE st WHEN 50 THEN {t_missing}
                WHEN 46 THEN {t_dup}
                WHEN -1 THEN CASE WHEN txn_id IS NULL THEN {t_notxn} ELSE {t_nobal} END
                WHEN 42 THEN NULL
                WHEN 43 THEN {t_spent} || {t_neg}
                WHEN 44 THEN {t_spent} || {t_some}
                ELSE {t_spent} || {t_all} END
      WHEN 'ADD_CREDIT' THEN
        CASE st WHEN 50 THEN {t_id_missing}
                WHEN 46 THEN {t_dup}
                WHEN -1 THEN {t_notxn}
                ELSE {t_added} END
      WHEN 'UPSERT_USER' THEN
        CASE WHEN st = 46 THEN {t_dup}
             WHEN st = -1 THEN {t_notxn}
             WHEN NOT ex0 THEN {t_created}
             ELSE {t_upserted} END
      WHEN 'LOCK_USER' THEN
        CASE st WHEN 50 THEN {t_missing}
                WHEN 53 THEN {t_locked}
                ELSE CAST(request_id AS VARCHAR) END
      WHEN 'UPDATE_USER' THEN
        CASE st WHEN 50 THEN {t_missing}
                WHEN 54 THEN {t_current}
                WHEN -1 THEN CASE WHEN NOT js_ok THEN {t_badjson} ELSE {t_badnum} END
                ELSE {t_updated} END
      ELSE NULL END AS status_text,
    CASE op WHEN 'REPORT_USAGE' THEN sess WHEN 'UPDATE_USER' THEN rsess
            WHEN 'LOCK_USER' THEN CASE st WHEN 53 THEN ls0 WHEN 54 THEN request_id END END AS session_id,
    CAST(appr AS BIGINT) AS approved, CAST(moved AS BIGINT) AS spent,
    CAST(CASE WHEN op = 'REPORT_USAGE' AND st BETWEEN 42 AND 45 AND used_neg <> 0 THEN used_neg
              WHEN op = 'ADD_CREDIT' AND st IN (46, 56) THEN amt
              WHEN op = 'UPSERT_USER' AND st = 42 THEN amt END AS BIGINT) AS ev_amount,
    CASE WHEN op = 'REPORT_USAGE' AND st BETWEEN 42 AND 45 AND used_neg <> 0 THEN {t_spent}
         WHEN op = 'ADD_CREDIT' AND st = 46 THEN {m_already}
         WHEN op = 'ADD_CREDIT' AND st = 56 THEN {m_added}
         WHEN op = 'UPSERT_USER' AND st = 42 AND NOT ex0 THEN {m_created}
         WHEN op = 'UPSERT_USER' AND st = 42 THEN {m_upserted} END AS ev_msg,
    txn_id AS ev_txn
  FROM ({s5})"""
    steps = init + "\n  UNION ALL\n" + rec
    return {"req": req, "steps": steps}


def decisions_sql() -> str:
    return """
SELECT request_id, userid, make_timestamp(t) AS txn_time, op, status, status_text, session_id, approved, spent,
       CAST(bal AS BIGINT) AS balance_after,
       CAST(coalesce(list_sum(list_transform(us, lambda x: x.a)), 0) AS BIGINT) AS allocated_after
FROM steps WHERE n > 0"""


def events_sql() -> str:
    return """
SELECT request_id, userid, ev_amount AS amount, ev_txn AS user_txn_id, ev_msg AS message, make_timestamp(t) AS txn_time
FROM steps WHERE n > 0 AND ev_msg IS NOT NULL"""
