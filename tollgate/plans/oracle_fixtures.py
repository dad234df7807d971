"""The FIXTURES.md derivations written as DuckDB CTEs.

Only the driver's tables are registered in the oracle's database, so every
oracle statement starts with the CTEs of the fixtures it reads.  ``with_fixtures``
adds the needed CTEs (and their dependencies) in front of a statement.
"""

from __future__ import annotations

import re

from tollgate.schema import MSG_USER_CREATED, SUMMARY_MARKER

BASE = 1704067200000000
HOUR = 3600 * 1000000


def _json(uid: str, number: str) -> str:
    return ("'{\"mysteriousHexPayload\":\"' || CAST(" + uid + " AS VARCHAR) || "
            "'\",\"loyaltySchemeName\":\"HelperCard\",\"loyaltySchemeNumber\":' || CAST("
            + number + " AS VARCHAR) || '}'")


# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), f"""
  SELECT event_id, ts, user_id, event_type, value,
         {BASE} + (epoch_us(ts) - {BASE}) // 180 AS t_us
  FROM events"""),
    "users": ((), f"""
  SELECT c_custkey AS userid,
         {_json('c_custkey', '(c_custkey >> 1)')} AS user_json_object,
         make_timestamp(CAST({BASE} AS BIGINT)) AS user_last_seen,
         CAST(NULL AS BIGINT) AS user_softlock_sessionid,
         CAST(NULL AS TIMESTAMP) AS user_softlock_expiry
  FROM customer"""),
    "opening_events": ((), f"""
  SELECT c_custkey AS userid, CAST(floor(c_acctbal) AS BIGINT) AS amount,
         'Create_' || CAST(c_custkey AS VARCHAR) AS user_txn_id, '{MSG_USER_CREATED}' AS message,
         make_timestamp(CAST({BASE} AS BIGINT)) AS txn_time
  FROM customer"""),
    "known_users": (("users",), "SELECT * FROM users WHERE userid % 10 <> 7"),
    "known_opening": (("opening_events",), "SELECT * FROM opening_events WHERE userid % 10 <> 7"),
    "req_fields": (("ev",), f"""
  SELECT event_id, user_id, event_type, t_us,
         CASE WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'DELETE_USER'
              WHEN event_type = 'signup' THEN 'UPSERT_USER'
              WHEN event_type = 'purchase' THEN 'ADD_CREDIT'
              ELSE 'REPORT_USAGE' END AS op,
         'T' || CAST(event_id AS VARCHAR) AS txn_id,
         CASE WHEN event_type IN ('click', 'view') AND event_id % 4 <> 0
              THEN user_id * 10 + event_id % 4 END AS session_id,
         CASE WHEN event_type = 'click' THEN event_id % 50
              WHEN event_type = 'view' THEN event_id % 30 END AS units_used,
         CASE WHEN event_type = 'click' THEN 1 + event_id % 2000
              WHEN event_type = 'view' THEN CAST(0 AS BIGINT) END AS units_wanted,
         CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS BIGINT)
              WHEN event_type = 'purchase' THEN CAST(floor(value * 10) AS BIGINT) END AS amount,
         CASE WHEN event_type = 'signup' AND event_id % 97 <> 0
              THEN {_json('user_id', '(user_id >> 1)')} END AS json
  FROM ev WHERE event_type <> 'error'"""),
    "requests": (("ev", "req_fields"), f"""
  SELECT event_id * 10 AS request_id, make_timestamp(t_us) AS txn_time, user_id AS userid, op,
         txn_id, session_id, units_used, units_wanted, amount, json, CAST(NULL AS VARCHAR) AS delta_op
  FROM req_fields
  UNION ALL
  SELECT s.event_id * 10, make_timestamp(s.t_us), s.user_id, f.op, f.txn_id, f.session_id,
         f.units_used, f.units_wanted, f.amount, f.json, CAST(NULL AS VARCHAR)
  FROM (SELECT event_id, t_us, user_id, event_type,
               max(CASE WHEN event_type <> 'error' THEN event_id END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src_id
        FROM ev) s
  JOIN req_fields f ON f.event_id = s.src_id
  WHERE s.event_type = 'error'
  UNION ALL
  SELECT event_id * 10 + k,
         make_timestamp(t_us + CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN 20000
                                    WHEN event_id % 2 = 0 THEN 30000 ELSE 90000 END),
         user_id,
         CASE WHEN k < 3 THEN 'LOCK_USER' ELSE 'UPDATE_USER' END,
         CAST(NULL AS VARCHAR),
         CASE WHEN k = 3 THEN CASE WHEN event_id % 4 = 1 THEN CAST(-1 AS BIGINT) ELSE event_id * 10 + 1 END END,
         CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
         CASE WHEN k = 3 THEN
              CASE WHEN event_id % 4 = 2 THEN
                   CASE WHEN event_id % 5 = 0 THEN 'abc' ELSE CAST(event_id AS VARCHAR) END
              ELSE {_json('user_id', 'event_id')} END END,
         CASE WHEN k = 3 AND event_id % 4 = 2 THEN 'NEW_LOYALTY_NUMBER' END
  FROM (SELECT *, 1 AS k FROM ev UNION ALL SELECT *, 2 FROM ev UNION ALL SELECT *, 3 FROM ev) x
  WHERE event_type = 'signup' AND event_id % 3 = 0"""),
    "requests_single": (("req_fields", "users"), """
  SELECT event_id * 10 AS request_id, make_timestamp(t_us) AS txn_time, user_id AS userid, op, txn_id,
         CASE WHEN op = 'REPORT_USAGE' THEN user_id END AS session_id,
         units_used, units_wanted, amount, json, CAST(NULL AS VARCHAR) AS delta_op
  FROM req_fields
  WHERE event_type IN ('purchase', 'click', 'view') AND user_id IN (SELECT userid FROM users)"""),
    "txns": (("ev",), """
  SELECT user_id AS userid, 'T' || CAST(event_id AS VARCHAR) AS user_txn_id,
         make_timestamp(t_us) AS txn_time,
         CASE WHEN event_type IN ('click', 'view') AND event_id % 4 <> 0
              THEN user_id * 10 + event_id % 4 END AS sessionid,
         CASE WHEN event_type = 'click' THEN event_id % 100 ELSE CAST(0 AS BIGINT) END AS approved_amount,
         CASE WHEN event_type = 'click' THEN -(event_id % 50)
              WHEN event_type = 'view' THEN -(event_id % 30)
              ELSE CAST(floor(value) AS BIGINT) END AS spent_amount,
         event_type AS purpose
  FROM ev WHERE event_type <> 'error'"""),
    "usage_raw": (("ev",), """
  SELECT user_id AS userid, event_id % 100 AS allocated_amount, user_id * 10 + event_id % 4 AS sessionid,
         make_timestamp(t_us) AS lastdate, event_id
  FROM ev WHERE event_type = 'click'"""),
    "usage": (("usage_raw",), """
  SELECT userid, allocated_amount, sessionid, lastdate FROM usage_raw"""),
    "usage_keyed": (("usage_raw",), """
  SELECT userid, allocated_amount, sessionid, lastdate FROM (
    SELECT *, row_number() OVER (PARTITION BY userid, sessionid ORDER BY lastdate DESC, event_id DESC) AS rn
    FROM usage_raw) WHERE rn = 1"""),
    "addcredit_msg": (("ev",), """
  SELECT 'T' || CAST(event_id AS VARCHAR) AS key,
         CASE WHEN event_id % 50 = 0 THEN '"x",,'
              ELSE '"' || CAST(user_id AS VARCHAR) || '","' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR)
                   || '","T' || CAST(event_id AS VARCHAR) || '"' END AS value
  FROM ev WHERE event_type = 'purchase'"""),
    "latency": ((), """
  SELECT event_id AS seq, event_type AS type, CAST(floor(value * 1000) - 500 AS INTEGER) AS latency,
         CASE WHEN event_id % 7 = 0 THEN 'c' || CAST(event_id AS VARCHAR) ELSE '' END AS comment,
         CAST(1 + event_id % 3 AS INTEGER) AS how_many
  FROM events"""),
    "run_groups": ((), """
  SELECT event_type, CAST(day(ts) AS BIGINT) AS day, count(*) AS c, min(ts) AS first_ts
  FROM events GROUP BY event_type, day(ts)"""),
}


def _run_log_sql() -> str:
    parts = ["CASE WHEN day % 3 = 0 THEN 'ami-1:t1:c5:1:Y:charge:8:3:run.log:' ELSE '' END",
             "strftime(first_ts, '%Y-%m-%d %H:%M:%S')", f"':{SUMMARY_MARKER}:'",
             "CAST(day * 10 AS VARCHAR)", "':'", "CAST(day * 10 * 10 * (85 + c % 20) AS VARCHAR)", "'.0:'"]
    for i in range(3):
        p99 = f"((c * 37 + {i * 1000}) % 20000)"
        for v in (f"((c + {i}) % 97)", f"((c * 3 + {i}) % 500)", p99, f"({p99} + 100)", f"({p99} + 200)",
                  f"({p99} + 300)", f"({p99} + 1000)"):
            parts += [f"CAST({v} AS VARCHAR)", "':'"]
        parts.append("CASE WHEN c % 5 = 0 THEN '1.2E7:' ELSE CAST(c % 5 AS VARCHAR) || '.0:' END")
    file = "'run_' || event_type || '.log'"
    text = " || ".join(parts)
    cut = f"CASE WHEN day % 7 = 0 THEN array_to_string(string_split({text}, ':')[1:12], ':') || ':oops' ELSE {text} END"
    return (f"\n  SELECT {file} AS file, {cut} AS line FROM run_groups"
            f"\n  UNION ALL\n  SELECT {file}, strftime(first_ts, '%Y-%m-%d %H:%M:%S') || ':Processed ' || "
            "CAST(c AS VARCHAR) || ' transactions' FROM run_groups")


CTES["run_log"] = (("run_groups",), _run_log_sql())
CTES["fin_events"] = (("opening_events", "txns"), """
  SELECT userid, amount, user_txn_id, message, txn_time FROM opening_events
  UNION ALL
  SELECT userid, spent_amount, user_txn_id, purpose, txn_time FROM txns WHERE spent_amount <> 0""")
CTES["users_locked"] = (("users",), f"""
  SELECT userid, user_json_object, user_last_seen,
         CASE WHEN userid % 3 = 0 THEN userid * 10 + 1 END AS user_softlock_sessionid,
         CASE WHEN userid % 3 = 0 THEN make_timestamp(CAST({BASE + 2 * HOUR} AS BIGINT) + (userid % 7 - 3) * 60000000) END
           AS user_softlock_expiry
  FROM users""")


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def _wide(name: str) -> tuple[tuple[str, ...], str]:
    """A fixture of the log at its own times: the same CTE over events that are not squeezed."""
    deps, body = CTES[name]
    for d in deps:
        body = re.sub(rf"\b{d}\b", f"{d}_wide", body)
    return tuple(f"{d}_wide" for d in deps), body.replace("// 180", "// 1")


CTES |= {f"{name}_wide": _wide(name) for name in ("ev", "req_fields", "requests")}


def with_fixtures(sql: str, *names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``sql`` with the CTEs it reads.  ``names`` lists fixtures; when
    empty they are detected from identifiers in the text.  ``extra`` adds
    statement-specific CTEs (in order) after the fixtures."""
    if not names:
        text = sql + " ".join((extra or {}).values())
        names = tuple(n for n in CTES if re.search(rf"\b{n}\b", text))
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in _closure(names)]
    parts += [f"{k} AS ({v}\n)" for k, v in (extra or {}).items()]
    body = sql.lstrip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if parts and body[:5].upper() == "WITH ":
        return head + ",\n".join(parts) + ",\n" + body[5:]
    return head + ",\n".join(parts) + "\n" + sql if parts else sql
