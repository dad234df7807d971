"""Registered charging queries: the replay fold (D1, D2, D6, D7), the closed
forms (D3, D4, D5), the user view (D8) and what is read off decisions (C5,
C6, M5)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.texts import text_sql
from tollgate.operators import audit as C
from tollgate.operators import charge as D
from tollgate.operators import metrics as M
from tollgate.operators.locks import lock_decisions as decide_locks
from tollgate.operators.segments import charge_by_segments as charge_segments
from tollgate.plans.oracle_fold import decisions_sql, events_sql, fold_ctes
from tollgate.plans.registry import register
from tollgate.session import ensure_checkpoint_dir
from tollgate.sources import fixtures as fx
from tollgate.streaming.charge_stream import request_stream


def replay(spark, sf, mode: str = "reference") -> D.ChargeResult:
    """The full request log replayed over the fixture users and balances."""
    return D.charge(fx.requests(spark, sf), users=fx.known_users(spark, sf),
                    opening_events=fx.known_opening(spark, sf), mode=mode)


def replay_single(spark, sf) -> D.ChargeResult:
    return D.charge(fx.requests_single_session(spark, sf), users=fx.users(spark, sf),
                    opening_events=fx.opening_events(spark, sf))


_TTL_US = 180 * 60 * 1000000
_FIRST_TS = "strftime(first_time, '%Y-%m-%d %H:%M:%S.%f')"

# The replay's oracle: a recursive CTE over the full log (see oracle_fold).
_KNOWN = ("known_users", "known_opening")
_FOLD = dict(fixtures=("requests", *_KNOWN), extra=fold_ctes("requests", *_KNOWN), recursive=True)
_DEC = decisions_sql()

_FINAL = """
SELECT userid,
       CASE WHEN ex THEN js END AS user_json_object,
       CASE WHEN ex THEN ls END AS user_softlock_sessionid,
       CASE WHEN ex THEN make_timestamp(le) END AS user_softlock_expiry,
       bal AS balance,
       CASE WHEN len(us) > 0 THEN CAST(list_sum(list_transform(us, lambda x: x.a)) AS BIGINT) END AS allocated,
       CASE WHEN len(us) > 0 THEN CAST(len(us) AS BIGINT) END AS sessions,
       CASE WHEN len(tx) > 0 THEN CAST(len(tx) AS BIGINT) END AS txns
FROM (SELECT userid, ex, js, ls, le, bal, us, tx FROM steps s
      WHERE n = (SELECT max(n) FROM steps s2 WHERE s2.userid = s.userid)
      UNION ALL
      SELECT u.userid, true, u.user_json_object, u.user_softlock_sessionid, epoch_us(u.user_softlock_expiry),
             (SELECT CAST(sum(amount) AS BIGINT) FROM known_opening o WHERE o.userid = u.userid), [], []
      FROM known_users u WHERE u.userid NOT IN (SELECT userid FROM requests))
WHERE ex OR bal IS NOT NULL"""


def _expected_sql() -> str:
    from tollgate import schema as S
    return " OR ".join(f"(op = '{op}' AND status IN ({', '.join(str(c) for c in codes)}))"
                       for op, codes in S.EXPECTED_STATUSES.items())

# DuckDB form of the single-session closed form (plain windows).
_SINGLE = f"""
WITH r AS (
  SELECT *, epoch_us(txn_time) AS t_us,
         CASE WHEN op = 'REPORT_USAGE' THEN -coalesce(units_used, 0) ELSE coalesce(amount, 0) END AS delta,
         coalesce(units_wanted, 0) AS wanted
  FROM requests_single),
o AS (SELECT userid, CAST(sum(amount) AS BIGINT) AS opening FROM opening_events GROUP BY userid),
b AS (SELECT r.*, CAST(coalesce(o.opening, 0) + coalesce(sum(delta) OVER (PARTITION BY r.userid ORDER BY t_us, request_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bal
      FROM r LEFT JOIN o USING (userid)),
d AS (SELECT *, CASE WHEN op <> 'REPORT_USAGE' OR wanted = 0 OR bal < 0 THEN 0
                     WHEN wanted > bal THEN bal ELSE wanted END AS appr FROM b),
g AS (SELECT *,
        last_value(CASE WHEN op = 'REPORT_USAGE' THEN t_us END IGNORE NULLS) OVER w AS gt,
        last_value(CASE WHEN op = 'REPORT_USAGE' THEN appr END IGNORE NULLS) OVER w AS ga
      FROM d WINDOW w AS (PARTITION BY userid ORDER BY t_us, request_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT request_id, userid, txn_time, op,
  CASE WHEN op <> 'REPORT_USAGE' THEN 56 WHEN wanted = 0 THEN 42 WHEN bal < 0 THEN 43
       WHEN wanted > bal THEN 44 ELSE 45 END AS status,
  CASE WHEN op <> 'REPORT_USAGE' THEN {text_sql(S.TEXT_CREDIT_ADDED, amount="amount", txn_id="txn_id")}
       WHEN wanted = 0 THEN NULL
       WHEN bal < 0 THEN {text_sql(S.TEXT_SPENT, spent="delta")} || {text_sql(S.TEXT_NEGATIVE_BALANCE, avail="bal")}
       WHEN wanted > bal THEN {text_sql(S.TEXT_SPENT, spent="delta")}
                              || {text_sql(S.TEXT_SOME_ALLOCATED, avail="bal", wanted="wanted")}
       ELSE {text_sql(S.TEXT_SPENT, spent="delta")} || {text_sql(S.TEXT_ALL_ALLOCATED, wanted="wanted")} END
    AS status_text,
  CASE WHEN op = 'REPORT_USAGE' THEN session_id END AS session_id,
  CAST(appr AS BIGINT) AS approved,
  CAST(delta AS BIGINT) AS spent,
  CAST(bal + delta AS BIGINT) AS balance_after,
  CAST(CASE WHEN gt IS NULL THEN 0 WHEN gt >= t_us - {_TTL_US} THEN ga ELSE 0 END AS BIGINT) AS allocated_after
FROM g"""


@register("report_usage_single_session", _SINGLE, ("requests_single", "opening_events"))
def report_usage_single_session(spark, sf):
    """D3: decisions of a single-session log by windows only (no Python)."""
    return D.report_usage_single_session(fx.requests_single_session(spark, sf), fx.opening_events(spark, sf))


@register("charge_single_session", _SINGLE, ("requests_single", "opening_events"))
def charge_single_session(spark, sf):
    """D1 fold on the single-session log: must equal D3's closed form."""
    return replay_single(spark, sf).decisions


@register("charge", _DEC, **_FOLD)
def charge(spark, sf):
    """Decisions of the full request log replayed per user."""
    return replay(spark, sf).decisions


@register("charge_events", events_sql(), **_FOLD)
def charge_events(spark, sf):
    """The financial events the replay exports."""
    return replay(spark, sf).events_with_request


@register("charge_final_state", _FINAL, **_FOLD)
def charge_final_state(spark, sf):
    """Final user row, balance, reservations (total and count) and
    ledger size per user after the replay."""
    return replay(spark, sf).final_summary()


_WIDE = dict(fixtures=("requests_wide", *_KNOWN), extra=fold_ctes("requests_wide", *_KNOWN), recursive=True)


def replay_segments(spark, sf) -> D.ChargeResult:
    return charge_segments(fx.requests(spark, sf, squeeze=1), users=fx.known_users(spark, sf),
                           opening_events=fx.known_opening(spark, sf))


@register("charge_by_segments", _DEC, **_WIDE)
def charge_by_segments(spark, sf):
    """D1 with every user's log split at idle gaps: decisions over the log at
    its own times, where nearly all users have many segments."""
    return replay_segments(spark, sf).decisions


@register("charge_by_segments_events", events_sql(), **_WIDE)
def charge_by_segments_events(spark, sf):
    """D1 split at idle gaps: the financial events."""
    return replay_segments(spark, sf).events_with_request


@register("charge_by_segments_final_state", _FINAL.replace("FROM requests)", "FROM requests_wide)"), **_WIDE)
def charge_by_segments_final_state(spark, sf):
    """D1 split at idle gaps: the state of every user after the log."""
    return replay_segments(spark, sf).final_summary()


@register("hot_users", """
SELECT userid, count(*) AS requests, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM requests) AS share
FROM requests GROUP BY userid ORDER BY requests DESC, userid LIMIT 10""", ("requests",))
def hot_users(spark, sf):
    """The ten users with the most requests and their share of the log (the
    longest tasks of a replay)."""
    return D.hot_users(fx.requests(spark, sf), 10)


@register("report_quota_usage", f"SELECT * FROM ({_DEC}) WHERE op = 'REPORT_USAGE'", **_FOLD)
def report_quota_usage(spark, sf):
    """The usage-report decisions of the replay."""
    return D.report_quota_usage(replay(spark, sf))


@register("lock_user", f"SELECT * FROM ({_DEC}) WHERE op = 'LOCK_USER'", **_FOLD)
def lock_user(spark, sf):
    """The lock decisions of the replay."""
    return D.lock_user(replay(spark, sf))


@register("update_locked_user", f"SELECT * FROM ({_DEC}) WHERE op = 'UPDATE_USER'", **_FOLD)
def update_locked_user(spark, sf):
    """The locked-update decisions of the replay."""
    return D.update_locked_user(replay(spark, sf))


@register("add_credit", f"""
WITH c AS (SELECT * FROM requests WHERE op = 'ADD_CREDIT'),
k AS (SELECT c.*, first_value(txn_time) OVER w AS first_time, first_value(request_id) OVER w AS first_id
      FROM c WHERE userid IN (SELECT userid FROM known_users)
      WINDOW w AS (PARTITION BY userid, txn_id ORDER BY txn_time, request_id))
SELECT request_id, userid, txn_time, op,
       CASE WHEN txn_id IS NULL THEN -1 WHEN request_id = first_id THEN 56 ELSE 46 END AS status,
       CASE WHEN txn_id IS NULL THEN {text_sql(S.TEXT_NO_TXN_ID, userid="userid")}
            WHEN request_id = first_id THEN {text_sql(S.TEXT_CREDIT_ADDED, amount="amount", txn_id="txn_id")}
            ELSE {text_sql(S.TEXT_ALREADY_HAPPENED, time=_FIRST_TS)} END AS status_text
FROM k
UNION ALL
SELECT request_id, userid, txn_time, op, 50, {text_sql(S.TEXT_USER_ID_MISSING, userid="userid")}
FROM c WHERE userid NOT IN (SELECT userid FROM known_users)""", ("requests", "known_users"))
def add_credit(spark, sf):
    """Credit decisions with an infinite duplicate horizon (closed form)."""
    return D.add_credit(fx.requests(spark, sf), fx.known_users(spark, sf))[0]


@register("upsert_user", f"""
WITH u AS (SELECT * FROM requests WHERE op = 'UPSERT_USER' AND txn_id IS NOT NULL),
k AS (SELECT u.*, first_value(txn_time) OVER w AS first_time, first_value(request_id) OVER w AS first_id,
             first_value(request_id) OVER (PARTITION BY userid ORDER BY txn_time, request_id) AS creator_id,
             userid IN (SELECT userid FROM known_users) AS pre
      FROM u WINDOW w AS (PARTITION BY userid, txn_id ORDER BY txn_time, request_id))
SELECT request_id, userid, txn_time, op, CASE WHEN request_id = first_id THEN 42 ELSE 46 END AS status,
       CASE WHEN request_id <> first_id THEN {text_sql(S.TEXT_ALREADY_HAPPENED, time=_FIRST_TS)}
            WHEN NOT pre AND request_id = creator_id THEN {text_sql(S.TEXT_USER_CREATED, userid="userid", amount="amount")}
            ELSE {text_sql(S.TEXT_USER_UPSERTED, userid="userid", amount="amount")} END AS status_text
FROM k
UNION ALL
SELECT request_id, userid, txn_time, op, -1, {text_sql(S.TEXT_NO_TXN_ID, userid="userid")}
FROM requests WHERE op = 'UPSERT_USER' AND txn_id IS NULL""", ("requests", "known_users"))
def upsert_user(spark, sf):
    """Upsert decisions in a static world (closed form)."""
    return D.upsert_user(fx.requests(spark, sf), fx.known_users(spark, sf))[0]


@register("user_360", """
SELECT u.*, CAST(coalesce(r.sessions, 0) AS BIGINT) AS sessions, CAST(coalesce(r.allocated, 0) AS BIGINT) AS allocated,
       b.balance, CAST(coalesce(l.txns, 0) AS BIGINT) AS txns, l.txn_spent, l.txn_approved, l.last_txn_time
FROM users u
LEFT JOIN (SELECT userid, count(*) AS sessions, CAST(sum(allocated_amount) AS BIGINT) AS allocated
           FROM usage_keyed GROUP BY userid) r USING (userid)
LEFT JOIN (SELECT userid, CAST(sum(amount) AS BIGINT) AS balance FROM fin_events GROUP BY userid) b USING (userid)
LEFT JOIN (SELECT userid, count(*) AS txns, CAST(sum(spent_amount) AS BIGINT) AS txn_spent,
                  CAST(sum(approved_amount) AS BIGINT) AS txn_approved, max(txn_time) AS last_txn_time
           FROM txns GROUP BY userid) l USING (userid)""", ("users", "usage_keyed", "fin_events", "txns"))
def user_360(spark, sf):
    """User, reservations, balance and ledger summarised per user."""
    return D.user_360(fx.users(spark, sf), fx.usage_keyed(spark, sf), fx.fin_events(spark, sf),
                      fx.txns(spark, sf))


@register("status_mix", f"""
SELECT op, status, count(*) AS how_many, NOT coalesce({_expected_sql()}, false) AS unexpected
FROM ({_DEC}) GROUP BY op, status""", **_FOLD)
def status_mix(spark, sf):
    """Replay decisions per (op, status), unexpected statuses flagged."""
    return C.status_mix(replay(spark, sf).decisions)


@register("status_mix_single_session", """
SELECT op, status, count(*) AS how_many, false AS unexpected FROM (""" + _SINGLE + """) GROUP BY op, status""",
          ("requests_single", "opening_events"))
def status_mix_single_session(spark, sf):
    """C5 on the closed-form decisions of the single-session log."""
    return C.status_mix(D.report_usage_single_session(fx.requests_single_session(spark, sf),
                                                      fx.opening_events(spark, sf)))


_CONTENTION = f"""
SELECT d.userid,
       count(CASE WHEN d.op = 'LOCK_USER' THEN 1 END) AS lock_attempts,
       count(CASE WHEN d.op = 'LOCK_USER' AND d.status = 53 THEN 1 END) AS lock_failures,
       count(CASE WHEN d.op = 'UPDATE_USER' AND d.status = 42 AND NOT coalesce(r.delta_op = 'NEW_LOYALTY_NUMBER', false)
                  THEN 1 END) AS full_updates,
       count(CASE WHEN d.op = 'UPDATE_USER' AND d.status = 42 AND coalesce(r.delta_op = 'NEW_LOYALTY_NUMBER', false)
                  THEN 1 END) AS delta_updates,
       count(CASE WHEN d.op = 'UPDATE_USER' AND d.status <> 42 THEN 1 END) AS update_failures
FROM ({_DEC}) d LEFT JOIN requests r ON r.request_id = d.request_id
WHERE d.op IN ('LOCK_USER', 'UPDATE_USER') GROUP BY d.userid"""


@register("lock_contention", _CONTENTION, **_FOLD)
def lock_contention(spark, sf):
    """Lock attempts, conflicts and updates per user from the replay."""
    return C.lock_contention(replay(spark, sf).decisions, fx.requests(spark, sf))


@register("lock_decisions", f"""
SELECT request_id, userid, txn_time, op, status, status_text, session_id
FROM ({_DEC}) WHERE op IN ('LOCK_USER', 'UPDATE_USER')""", **_FOLD)
def lock_decisions(spark, sf):
    """D6 and D7 by windows, without the replay."""
    return decide_locks(fx.requests(spark, sf), fx.known_users(spark, sf))


@register("lock_contention_by_windows", _CONTENTION, **_FOLD)
def lock_contention_by_windows(spark, sf):
    """C6 over the decisions by windows, without the replay."""
    requests = fx.requests(spark, sf)
    return C.lock_contention(decide_locks(requests, fx.known_users(spark, sf)), requests)


@register("negative_after_decision", f"SELECT * FROM ({_DEC}) WHERE balance_after - allocated_after < 0", **_FOLD)
def negative_after_decision(spark, sf):
    """C2 on decisions: answers that left the spendable balance below zero."""
    return C.negative_after_decision(replay(spark, sf).decisions)


@register("allocated_series", f"""
SELECT txn_time, CAST(sum(delta) OVER (ORDER BY txn_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS allocated_amount
FROM (SELECT date_trunc('minute', txn_time) AS txn_time, sum(delta) AS delta
      FROM (SELECT txn_time, allocated_after - coalesce(lag(allocated_after) OVER (PARTITION BY userid
                   ORDER BY txn_time, request_id), 0) AS delta
            FROM ({_DEC}) WHERE allocated_after IS NOT NULL)
      GROUP BY date_trunc('minute', txn_time))""", **_FOLD)
def allocated_series(spark, sf):
    """M5: total reserved credit per minute, from the replay's decisions."""
    return M.allocated_series(replay(spark, sf).decisions)


@register("value_at_risk_series", f"""
WITH d AS (SELECT userid, session_id, request_id, epoch_us(txn_time) AS t, op, approved FROM ({_DEC})
           WHERE op = 'DELETE_USER' OR (op = 'REPORT_USAGE' AND status BETWEEN 42 AND 45)),
o AS (SELECT *, lead(t) OVER (PARTITION BY userid, session_id ORDER BY t, request_id) AS touched,
             min(CASE WHEN op = 'DELETE_USER' THEN t END) OVER (PARTITION BY userid ORDER BY t, request_id
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS deleted FROM d),
c AS (SELECT t AS c_at, approved AS delta FROM o WHERE op <> 'DELETE_USER' AND approved <> 0
      UNION ALL
      SELECT least(coalesce(touched, t + {_TTL_US}), coalesce(deleted, t + {_TTL_US}), t + {_TTL_US}), -approved
      FROM o WHERE op <> 'DELETE_USER' AND approved <> 0),
m AS (SELECT date_trunc('minute', make_timestamp(CAST(c_at AS BIGINT))) AS txn_time, sum(delta) AS delta FROM c GROUP BY 1)
SELECT txn_time, CAST(sum(delta) OVER (ORDER BY txn_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS allocated_amount FROM m""", **_WIDE)
def value_at_risk_series(spark, sf):
    """M5 exactly: reserved credit per minute over the log at its own times,
    idle users' reservations expiring when their time is up."""
    return M.value_at_risk_series(replay_segments(spark, sf).decisions)


@register("charge_stream", _DEC, **_FOLD)
def charge_stream(spark, sf):
    """The replay as a running stream: the log before the middle of its
    time range is processed, the query stops, the rest arrives and the query
    resumes from its checkpoint (RocksDB state, idempotent sink).  Its
    decisions must equal D1's."""
    from tollgate.streaming import charge_stream as CS
    root = _two_runs(spark, sf, "charge-stream", CS.run_available)
    return CS.decisions_of(CS.read_charge_outputs(spark, os.path.join(root, "out")))


def _two_runs(spark, sf, name: str, run) -> str:
    """The log before the middle of its time range arrives and is processed,
    then the rest, by a query that resumes from its checkpoint; the folder with
    the outputs (out) and the checkpoint (state)."""
    root = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    log, inbox = os.path.join(root, "log"), os.path.join(root, "in")
    fx.requests(spark, sf).write.parquet(log)              # derived once
    req = spark.read.schema(S.REQUESTS).parquet(log)
    t = F.unix_micros("txn_time")
    lo, hi = req.agg(F.min(t), F.max(t)).first()           # partial aggregates, not an exact median
    late = F.coalesce(t >= F.lit((lo + hi) // 2 + 1), F.lit(True))
    for part in (~late, late):
        req.filter(part).write.mode("append").parquet(inbox)
        run(request_stream(spark, inbox), os.path.join(root, "out"), os.path.join(root, "state"),
            users=fx.known_users(spark, sf), opening_events=fx.known_opening(spark, sf))
    return root


@register("charge_stream_timed", _DEC, **_FOLD)
def charge_stream_timed(spark, sf):
    """D9 over map state with event-time timers, stopped and resumed: its
    decisions must equal D1's."""
    from tollgate.streaming import charge_stream as CS
    from tollgate.streaming import timed_charge as TC
    root = _two_runs(spark, sf, "charge-timed", TC.run_timed)
    return CS.decisions_of(CS.read_charge_outputs(spark, os.path.join(root, "out")))


#: the first millisecond behind a reservation's TTL has been reached by the final watermark (10 minutes behind the log's end)
_TIMED_OUT = f"(d + {_TTL_US}) // 1000 + 1 <= (SELECT epoch_us(max(txn_time)) // 1000 - 600000 FROM requests)"


@register("reservation_releases", f"""
WITH held AS (SELECT userid, n, unnest(us) AS u FROM steps WHERE n > 0),
last AS (SELECT userid, u.s AS s, u.d AS d, arg_max(u.a, n) AS a, max(n) AS n FROM held GROUP BY userid, u.s, u.d)
SELECT l.userid, l.s AS session_id, CAST(l.a AS BIGINT) AS amount, make_timestamp(CAST(d + {_TTL_US} AS BIGINT)) AS released_at
FROM last l LEFT JOIN steps nx ON nx.userid = l.userid AND nx.n = l.n + 1
WHERE CASE WHEN nx.t IS NULL THEN {_TIMED_OUT} ELSE l.d < nx.t - {_TTL_US} END""", **_FOLD)
def reservation_releases(spark, sf):
    """R1 as the stream does it: the reservations that passed their TTL, those
    of idle users by event-time timers, over a restart."""
    from tollgate.streaming import charge_stream as CS
    from tollgate.streaming import timed_charge as TC
    root = _two_runs(spark, sf, "releases", TC.run_timed)
    return TC.releases_of(CS.read_charge_outputs(spark, os.path.join(root, "out")))


@register("user_360_live", _FINAL.replace("SELECT userid, ex, js, ls, le, bal, us, tx FROM steps s", f"""
SELECT userid, ex, js, ls, le, bal, list_filter(us, lambda x: (x.d + {_TTL_US}) // 1000 + 1 > mark) AS us, tx
FROM (SELECT epoch_us(max(txn_time)) // 1000 - 600000 AS mark FROM requests), steps s"""), **_FOLD)
def user_360_live(spark, sf):
    """D8 over the running stream: every user's row, balance, reservations and
    ledger size, read from the checkpoint's state."""
    from tollgate.streaming import timed_charge as TC
    root = _two_runs(spark, sf, "user-live", TC.run_timed)
    return TC.read_state(spark, os.path.join(root, "state")).final_summary()
