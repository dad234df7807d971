"""Registered queries over the state tables: sources (S), lookups (F), views
(A), ordered selections (T, V), retention (R), metrics (M1-M4, M6) and
audits (C1-C4)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.texts import text_sql
from tollgate.operators import audit as C
from tollgate.operators import lookups as L
from tollgate.operators import maintenance as R
from tollgate.operators import metrics as M
from tollgate.operators import topk as TK
from tollgate.operators import views as V
from tollgate.plans.registry import register
from tollgate.session import ensure_checkpoint_dir
from tollgate.sources import finevents as FE
from tollgate.sources import fixtures as fx
from tollgate.sources import messages as MS
from tollgate.sources.tables import table

METRICS_AS_OF = fx.METRICS_AS_OF_US        # base + 2 h
RETENTION_AS_OF = fx.RETENTION_AS_OF_US    # base + 4 h
SQL_METRICS_AS_OF = "TIMESTAMP '2024-01-01 02:00:00'"
SQL_RETENTION_AS_OF = "TIMESTAMP '2024-01-01 04:00:00'"


# ---------------------------------------------------------------- sources ---

@register("src_users", "SELECT * FROM users", ("users",))
def src_users(spark, sf):
    """The user relation read with its explicit schema."""
    return fx.users(spark, sf)


@register("src_addcredit_csv", """
SELECT key, value, userid, amount, txn_id,
       (userid IS NOT NULL AND amount IS NOT NULL AND txn_id IS NOT NULL) AS valid
FROM (SELECT key, value,
             TRY_CAST(trim(split_part(value, ',', 1), '"') AS BIGINT) AS userid,
             TRY_CAST(trim(split_part(value, ',', 2), '"') AS BIGINT) AS amount,
             NULLIF(trim(split_part(value, ',', 3), '"'), '') AS txn_id
      FROM addcredit_msg)""", ("addcredit_msg",))
def src_addcredit_csv(spark, sf):
    """Decode add-credit messages; malformed ones are flagged invalid."""
    return MS.decode_addcredit(fx.addcredit_messages(spark, sf))


def _scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("sink_financial_events", "SELECT userid, amount, user_txn_id, message, txn_time FROM fin_events",
          ("fin_events",))
def sink_financial_events(spark, sf):
    """S3: write the events through the idempotent sink twice (a retried batch)
    and read them back: every event exactly once."""
    path = _scratch(spark, "fin-events")
    ev = fx.fin_events(spark, sf)
    FE.write_financial_events(ev, path, batch_id=0)
    FE.write_financial_events(ev, path, batch_id=0)
    return FE.tail_financial_events(spark, path)


@register("tail_financial_events", f"""
SELECT userid, amount, user_txn_id, message, txn_time FROM fin_events
WHERE txn_time > {SQL_METRICS_AS_OF}""", ("fin_events",))
def tail_financial_events(spark, sf):
    """Consume only events after a point in time from the exported folder."""
    path = _scratch(spark, "fin-events")
    FE.write_financial_events(fx.fin_events(spark, sf), path, batch_id=1)
    return FE.tail_financial_events(spark, path, since=METRICS_AS_OF)


@register("topic_retention", f"""
SELECT * FROM fin_events WHERE txn_time >= {SQL_RETENTION_AS_OF} - INTERVAL 2 HOUR""", ("fin_events",))
def topic_retention(spark, sf):
    """Events a topic keeping two hours still holds at as_of."""
    return FE.topic_retention(fx.fin_events(spark, sf), RETENTION_AS_OF)


@register("src_run_logs", f"SELECT file, line FROM run_log WHERE contains(line, '{S.SUMMARY_MARKER}:')", ("run_log",))
def src_run_logs(spark, sf):
    """Keep the summary lines of benchmark logs."""
    return MS.summary_lines(fx.run_log(spark, sf))


# ---------------------------------------------------------------- lookups ---

@register("user_by_id", "SELECT * FROM users WHERE userid IN (SELECT userid FROM requests)",
          ("users", "requests"))
def user_by_id(spark, sf):
    """F1 (bulk): the user rows of every user id the request log names."""
    return L.user_by_id(fx.users(spark, sf), fx.requests(spark, sf).select("userid"))


@register("find_by_loyalty_card", """
SELECT e.event_id AS probe_id, u.*
FROM events e JOIN users u
  ON json_extract_string(u.user_json_object, '$.loyaltySchemeNumber') = CAST(e.user_id >> 1 AS VARCHAR)
WHERE e.event_type = 'purchase'""", ("users",))
def find_by_loyalty_card(spark, sf):
    """F2 (bulk): users matching the card number shown at each purchase, the
    purchasing user's; two users share a card, so rows grow with the purchases."""
    probes = (table(spark, sf, "events", "event_id", "user_id", "event_type").filter(F.col("event_type") == "purchase")
              .select(F.col("event_id").alias("probe_id"), F.shiftright("user_id", 1).alias("card")))
    return L.find_by_loyalty_card(fx.users(spark, sf), probes)


@register("show_transactions", "SELECT * FROM txns ORDER BY userid, txn_time, user_txn_id", ("txns",))
def show_transactions(spark, sf):
    """ledger rows per user in (txn_time, txn id) order."""
    return L.show_transactions(fx.txns(spark, sf))


@register("user_txn_ids", "SELECT userid, user_txn_id, txn_time FROM txns", ("txns",))
def user_txn_ids(spark, sf):
    """(txn id, time) of every ledger row."""
    return L.user_txn_ids(fx.txns(spark, sf))


@register("user_sessions_of", "SELECT * FROM usage_keyed ORDER BY userid, sessionid", ("usage_keyed",))
def user_sessions_of(spark, sf):
    """reservations per user ordered by session."""
    return L.user_sessions_of(fx.usage_keyed(spark, sf))


@register("unknown_user_requests", "SELECT * FROM requests WHERE userid NOT IN (SELECT userid FROM known_users)",
          ("requests", "known_users"))
def unknown_user_requests(spark, sf):
    """requests for users that do not exist in the user table."""
    return L.unknown_user_requests(fx.requests(spark, sf), fx.known_users(spark, sf))


@register("duplicate_requests", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY userid, txn_id ORDER BY txn_time, request_id) AS rn
  FROM requests WHERE txn_id IS NOT NULL) WHERE rn > 1""", ("requests",))
def duplicate_requests(spark, sf):
    """requests repeating an earlier (userid, txn id), infinite horizon."""
    return L.duplicate_requests(fx.requests(spark, sf))


@register("loyalty_delta_update", """
SELECT r.request_id, r.userid, r.json AS payload,
       CASE WHEN ok THEN '{"mysteriousHexPayload":"' || json_extract_string(u.user_json_object, '$.mysteriousHexPayload')
                         || '","loyaltySchemeName":"' || json_extract_string(u.user_json_object, '$.loyaltySchemeName')
                         || '","loyaltySchemeNumber":' || CAST(TRY_CAST(r.json AS BIGINT) AS VARCHAR) || '}' END AS new_json,
       CASE WHEN NOT ok THEN {BAD_NUMBER} END AS error
FROM (SELECT *, coalesce(regexp_full_match(json, '[+-]?[0-9]+') AND TRY_CAST(json AS BIGINT) IS NOT NULL, false) AS ok
      FROM requests WHERE delta_op = 'NEW_LOYALTY_NUMBER') r
JOIN users u USING (userid)""".replace("{BAD_NUMBER}", text_sql(S.TEXT_BAD_NUMBER, payload="coalesce(r.json, 'null')")),
          ("requests", "users"))
def loyalty_delta_update(spark, sf):
    """F8: apply every NEW_LOYALTY_NUMBER delta of the log to the user's JSON."""
    upd = fx.requests(spark, sf).filter(F.col("delta_op") == "NEW_LOYALTY_NUMBER")
    return L.loyalty_delta(fx.users(spark, sf), upd)


# ------------------------------------------------------ scalar functions ---

@register("minute_trunc", """
SELECT userid, user_txn_id, txn_time, date_trunc('minute', txn_time) AS minute FROM txns""", ("txns",))
def minute_trunc(spark, sf):
    """TRUNCATE(MINUTE, txn_time) of every ledger row."""
    from tollgate.functions.columns import minute_trunc as mt
    return fx.txns(spark, sf).select("userid", "user_txn_id", "txn_time", mt("txn_time").alias("minute"))


@register("date_shift", """
SELECT request_id, txn_time, txn_time - INTERVAL 1 MINUTE AS minute_before,
       txn_time + INTERVAL 50 MILLISECOND AS lock_expiry FROM requests""", ("requests",))
def date_shift(spark, sf):
    """DATEADD(MINUTE, -1, t) and DATEADD(MILLISECOND, 50, t) per request."""
    from tollgate.functions.columns import date_shift as ds
    r = fx.requests(spark, sf)
    return r.select("request_id", "txn_time", ds("txn_time", minutes=-1).alias("minute_before"),
                    ds("txn_time", millis=50).alias("lock_expiry"))


@register("null_default", """
SELECT r.request_id, r.userid, CAST(coalesce(a.s, 0) AS BIGINT) AS allocated_amount
FROM requests r LEFT JOIN (SELECT userid, sum(allocated_amount) AS s FROM usage GROUP BY userid) a USING (userid)""",
          ("requests", "usage"))
def null_default(spark, sf):
    """nvl(sum(reserved), 0) of the requesting user, per request."""
    from tollgate.functions.columns import null_default as nd
    per_user = fx.usage(spark, sf).groupBy("userid").agg(F.sum("allocated_amount").alias("s"))
    return (fx.requests(spark, sf).select("request_id", "userid").join(per_user, "userid", "left")
            .select("request_id", "userid", nd("s").cast("long").alias("allocated_amount")))


# ------------------------------------------------------------------ views ---

@register("current_locks", "SELECT count(*) AS how_many FROM users_locked WHERE user_softlock_expiry IS NOT NULL",
          ("users_locked",))
def current_locks(spark, sf):
    """A1: users with a lock expiry set, expired ones included (Q8)."""
    return V.current_locks(fx.users_locked(spark, sf))


@register("user_balance", "SELECT userid, CAST(sum(amount) AS BIGINT) AS balance FROM fin_events GROUP BY userid",
          ("fin_events",))
def user_balance(spark, sf):
    """A2: balance per user over the financial events."""
    return V.user_balance(fx.fin_events(spark, sf))


@register("allocated_credit", "SELECT CAST(sum(allocated_amount) AS BIGINT) AS allocated_amount FROM usage",
          ("usage",))
def allocated_credit(spark, sf):
    """A3: total reserved credit."""
    return V.allocated_credit(fx.usage(spark, sf))


@register("user_allocated", """
SELECT u.userid, CAST(coalesce(a.s, 0) AS BIGINT) AS allocated_amount
FROM users u LEFT JOIN (SELECT userid, CAST(sum(allocated_amount) AS BIGINT) AS s FROM usage GROUP BY userid) a
  USING (userid)""", ("users", "usage"))
def user_allocated(spark, sf):
    """A4: reserved credit per user (0 when none)."""
    return V.user_allocated(fx.users(spark, sf), fx.usage(spark, sf))


@register("users_sessions", "SELECT userid, sessionid, count(*) AS how_many FROM usage GROUP BY userid, sessionid",
          ("usage",))
def users_sessions(spark, sf):
    """A5: reservation rows per (user, session)."""
    return V.users_sessions(fx.usage(spark, sf))


_ACT = """
SELECT date_trunc('minute', txn_time) AS txn_time, CAST(sum({appr}) AS BIGINT) AS approved_amount,
       CAST(sum(spent_amount) AS BIGINT) AS spent_amount, count(*) AS how_many
FROM txns WHERE {cond} GROUP BY date_trunc('minute', txn_time)"""


@register("recent_activity_out", _ACT.format(appr="approved_amount * -1", cond="spent_amount <= 0"), ("txns",))
def recent_activity_out(spark, sf):
    """Per-minute outflow (reservations and spend)."""
    return V.recent_activity_out(fx.txns(spark, sf))


@register("recent_activity_in", _ACT.format(appr="approved_amount", cond="spent_amount > 0"), ("txns",))
def recent_activity_in(spark, sf):
    """Per-minute inflow (credits)."""
    return V.recent_activity_in(fx.txns(spark, sf))


@register("cluster_activity_by_users", "SELECT userid, count(*) AS how_many FROM txns GROUP BY userid", ("txns",))
def cluster_activity_by_users(spark, sf):
    """Ledger rows per user."""
    return V.cluster_activity_by_users(fx.txns(spark, sf))


@register("cluster_activity", """
SELECT date_trunc('minute', txn_time) AS txn_time, count(*) AS how_many FROM txns
GROUP BY date_trunc('minute', txn_time)""", ("txns",))
def cluster_activity(spark, sf):
    """Ledger rows per minute."""
    return V.cluster_activity(fx.txns(spark, sf))


@register("last_cluster_activity", "SELECT max(txn_time) AS txn_time FROM txns", ("txns",))
def last_cluster_activity(spark, sf):
    """A10: time of the latest ledger row."""
    return V.last_cluster_activity(fx.txns(spark, sf))


@register("cluster_users", "SELECT count(*) AS how_many FROM users", ("users",))
def cluster_users(spark, sf):
    """Number of users."""
    return V.cluster_users(fx.users(spark, sf))


@register("user_id_range", f"""
SELECT min(userid) AS min_userid, max(userid) AS max_userid,
       CASE WHEN min(userid) IS NULL THEN '{S.TEXT_NO_USERS}' END AS message FROM users""", ("users",))
def user_id_range(spark, sf):
    """Lowest and highest user id."""
    return V.user_id_range(fx.users(spark, sf))


# ----------------------------------------------------- ordered selections ---

@register("multi_session_ref", """
SELECT * FROM (SELECT userid, sessionid, count(*) AS how_many FROM usage GROUP BY userid, sessionid)
WHERE how_many > 1 ORDER BY how_many, userid, sessionid LIMIT 50""", ("usage",))
def multi_session_ref(spark, sf):
    """The reference's multi-session report (top 50 by its order)."""
    return TK.multi_session_ref(fx.usage(spark, sf))


@register("multi_session_users", """
SELECT userid, count(DISTINCT sessionid) AS how_many FROM usage GROUP BY userid
HAVING count(DISTINCT sessionid) > 1 ORDER BY how_many, userid LIMIT 50""", ("usage",))
def multi_session_users(spark, sf):
    """Users holding more than one session (top 50)."""
    return TK.multi_session_users(fx.usage(spark, sf))


@register("oldest_txn_per_user", """
SELECT userid, txn_time, user_txn_id, sessionid, approved_amount, spent_amount, purpose FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY txn_time, user_txn_id) AS rn FROM txns)
WHERE rn = 1""", ("txns",))
def oldest_txn_per_user(spark, sf):
    """Each user's oldest ledger row."""
    return TK.oldest_txn_per_user(fx.txns(spark, sf))


@register("two_oldest_stale_txns", f"""
SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY txn_time, user_txn_id) AS rn
  FROM txns WHERE txn_time < {SQL_METRICS_AS_OF} - INTERVAL 1 MINUTE)
WHERE rn <= 2""", ("txns",))
def two_oldest_stale_txns(spark, sf):
    """Per user the two oldest ledger rows older than one minute."""
    return TK.two_oldest_stale_txns(fx.txns(spark, sf), METRICS_AS_OF)


# -------------------------------------------------------------- retention ---

@register("ttl_usage", f"SELECT * FROM usage WHERE lastdate >= {SQL_RETENTION_AS_OF} - INTERVAL 180 MINUTE",
          ("usage",))
def ttl_usage(spark, sf):
    """Reservations kept by the 180-minute TTL."""
    return R.ttl_usage(fx.usage(spark, sf), RETENTION_AS_OF)


@register("ttl_txns", f"SELECT * FROM txns WHERE txn_time >= {SQL_RETENTION_AS_OF} - INTERVAL 3600 SECOND",
          ("txns",))
def ttl_txns(spark, sf):
    """R2: ledger rows kept by the one-hour TTL."""
    return R.ttl_txns(fx.txns(spark, sf), RETENTION_AS_OF)


@register("prune_two", f"""
SELECT * FROM txns t WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT userid, user_txn_id,
                        row_number() OVER (PARTITION BY userid ORDER BY txn_time, user_txn_id) AS rn
                 FROM txns WHERE txn_time < {SQL_METRICS_AS_OF} - INTERVAL 1 MINUTE) d
  WHERE d.rn <= 2 AND d.userid = t.userid AND d.user_txn_id = t.user_txn_id)""", ("txns",))
def prune_two(spark, sf):
    """Ledger after deleting each user's two oldest stale rows."""
    return R.prune_two(fx.txns(spark, sf), METRICS_AS_OF)


@register("prune_oldest", f"""
SELECT * FROM txns t WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT userid, user_txn_id, txn_time,
                        row_number() OVER (PARTITION BY userid ORDER BY txn_time, user_txn_id) AS rn FROM txns) d
  WHERE d.rn = 1 AND d.txn_time < {SQL_METRICS_AS_OF} - INTERVAL 5 MINUTE
    AND d.userid = t.userid AND d.user_txn_id = t.user_txn_id)""", ("txns",))
def prune_oldest(spark, sf):
    """Ledger after deleting each user's oldest row when older than 5 min."""
    return R.prune_oldest(fx.txns(spark, sf), METRICS_AS_OF)


@register("delete_users", "SELECT * FROM txns WHERE userid NOT IN (SELECT userid FROM requests WHERE op = 'DELETE_USER')",
          ("txns", "requests"))
def delete_users(spark, sf):
    """Ledger after deleting every user the log asks to delete."""
    doomed = fx.requests(spark, sf).filter(F.col("op") == "DELETE_USER").select("userid")
    return R.delete_users({"txns": fx.txns(spark, sf)}, ids=doomed)["txns"]


@register("unlock_all", """
SELECT userid, user_json_object, user_last_seen,
       CASE WHEN user_softlock_sessionid IS NULL THEN user_softlock_sessionid END AS user_softlock_sessionid,
       CASE WHEN user_softlock_sessionid IS NULL THEN user_softlock_expiry END AS user_softlock_expiry
FROM users_locked""", ("users_locked",))
def unlock_all(spark, sf):
    """Every soft lock released."""
    return R.unlock_all(fx.users_locked(spark, sf))


# ---------------------------------------------------------------- metrics ---

_MINUTE = f"date_trunc('minute', {SQL_METRICS_AS_OF} - INTERVAL 1 MINUTE)"


def _metric(name, expr, cond):
    return (f"SELECT '{name}' AS statname, '{name}' AS stathelp, CAST({expr} AS BIGINT) AS statvalue FROM txns "
            f"WHERE {cond} AND date_trunc('minute', txn_time) = {_MINUTE} HAVING count(*) > 0")


_MN = S.METRIC_NAMES


@register("current_metrics", "\nUNION ALL\n".join([
    f"SELECT '{_MN[0]}' AS statname, '{_MN[0]}' AS stathelp, count(*) AS statvalue FROM users_locked "
    "WHERE user_softlock_expiry IS NOT NULL",
    f"SELECT '{_MN[1]}', '{_MN[1]}', count(*) FROM users_locked",
    f"SELECT '{_MN[2]}', '{_MN[2]}', CAST(sum(allocated_amount) AS BIGINT) FROM usage_keyed",
    _metric(_MN[3], "sum(approved_amount * -1)", "spent_amount <= 0"),
    _metric(_MN[4], "sum(spent_amount)", "spent_amount <= 0"),
    _metric(_MN[5], "count(*)", "spent_amount <= 0"),
    _metric(_MN[6], "sum(spent_amount)", "spent_amount > 0"),
    _metric(_MN[7], "count(*)", "spent_amount > 0"),
]), ("users_locked", "usage_keyed", "txns"))
def current_metrics(spark, sf):
    """M1: the metrics procedure's eight statistics at as_of."""
    return M.current_metrics(fx.users_locked(spark, sf), fx.usage_keyed(spark, sf), fx.txns(spark, sf),
                             METRICS_AS_OF)


@register("credit_flow_per_minute", """
SELECT date_trunc('minute', txn_time) AS txn_time,
       CAST(sum(CASE WHEN spent_amount > 0 THEN spent_amount END) AS BIGINT) AS added,
       CAST(sum(CASE WHEN spent_amount <= 0 THEN approved_amount END) AS BIGINT) AS approved,
       CAST(-sum(CASE WHEN spent_amount <= 0 THEN spent_amount END) AS BIGINT) AS spent
FROM txns GROUP BY date_trunc('minute', txn_time)""", ("txns",))
def credit_flow_per_minute(spark, sf):
    """M2: credit added, approved and spent per minute (positive values)."""
    return M.credit_flow_per_minute(fx.txns(spark, sf))


@register("calls_per_minute", """
SELECT date_trunc('minute', txn_time) AS txn_time,
       count(CASE WHEN spent_amount > 0 THEN 1 END) AS add_credit_calls,
       count(CASE WHEN spent_amount <= 0 THEN 1 END) AS report_usage_calls
FROM txns GROUP BY date_trunc('minute', txn_time)""", ("txns",))
def calls_per_minute(spark, sf):
    """M3: credit vs usage ledger rows per minute."""
    return M.calls_per_minute(fx.txns(spark, sf))


@register("user_lock_gauges", "SELECT count(*) AS user_count, count(user_softlock_expiry) AS user_locks FROM users_locked",
          ("users_locked",))
def user_lock_gauges(spark, sf):
    """M4: registered and locked users."""
    return M.user_lock_gauges(fx.users_locked(spark, sf))


@register("procedure_rate", """
SELECT date_trunc('minute', txn_time) AS txn_time, op, CAST(count(*) AS DOUBLE) / 60 AS per_second
FROM requests WHERE op IN ('LOCK_USER', 'UPDATE_USER') GROUP BY date_trunc('minute', txn_time), op""",
          ("requests",))
def procedure_rate(spark, sf):
    """M6: lock and update calls per second, per minute."""
    return M.procedure_rate(fx.requests(spark, sf))


# ----------------------------------------------------------------- audits ---

_SPENDABLE = """
SELECT b.userid, b.balance, CAST(coalesce(r.reserved, 0) AS BIGINT) AS reserved,
       CAST(b.balance - coalesce(r.reserved, 0) AS BIGINT) AS spendable
FROM (SELECT userid, CAST(sum(amount) AS BIGINT) AS balance FROM fin_events GROUP BY userid) b
LEFT JOIN (SELECT userid, CAST(sum(allocated_amount) AS BIGINT) AS reserved FROM usage_keyed GROUP BY userid) r
  USING (userid)"""


def _spendable(spark, sf):
    return C.spendable_balance(fx.fin_events(spark, sf), fx.usage_keyed(spark, sf))


@register("spendable_balance", _SPENDABLE, ("fin_events", "usage_keyed"))
def spendable_balance(spark, sf):
    """Balance minus reserved credit per user."""
    return _spendable(spark, sf)


@register("negative_balance_audit", f"SELECT * FROM ({_SPENDABLE}) WHERE spendable < 0", ("fin_events", "usage_keyed"))
def negative_balance_audit(spark, sf):
    """Users whose spendable balance is negative."""
    return C.negative_balance_audit(_spendable(spark, sf))


@register("missing_balance_audit",
          "SELECT userid FROM users WHERE userid NOT IN (SELECT userid FROM known_opening) "
          "AND userid NOT IN (SELECT userid FROM txns WHERE spent_amount <> 0)",
          ("users", "known_opening", "txns"))
def missing_balance_audit(spark, sf):
    """Customers without any financial event, where those that had not
    signed up have no opening one."""
    return C.missing_balance_audit(fx.users(spark, sf).select("userid"), fx.fin_events(spark, sf, fx.known_opening))


@register("topup_candidates", f"SELECT * FROM ({_SPENDABLE}) WHERE spendable < 1000", ("fin_events", "usage_keyed"))
def topup_candidates(spark, sf):
    """C4: users whose spendable balance is below 1000."""
    return C.topup_candidates(_spendable(spark, sf))
