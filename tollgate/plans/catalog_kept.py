"""Registered queries over kept structures: views updated by signed changes
and the card index."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tollgate.operators import cardindex as X
from tollgate.operators import incremental as I
from tollgate.operators import maintenance as R
from tollgate.plans.registry import register
from tollgate.session import cut_lineage, ensure_checkpoint_dir
from tollgate.sources import fixtures as fx
from tollgate.sources.tables import table

PUT_IN_FROM = fx.BASE_US + 3 * fx.HOUR_US          # what happens later arrives as a batch
SQL_PUT_IN_FROM = "TIMESTAMP '2024-01-01 03:00:00'"
PRUNE_AS_OF = fx.BASE_US + 3 * fx.HOUR_US + fx.HOUR_US // 2
SQL_PRUNE_AS_OF = "TIMESTAMP '2024-01-01 03:30:00'"
SQL_AS_OF = "TIMESTAMP '2024-01-01 04:00:00'"

_OLDEST = "row_number() OVER (PARTITION BY userid ORDER BY txn_time, user_txn_id)"

#: the ledger and the reservations after the five batches, from scratch
_KEPT_CTES = {
    "gone": "SELECT userid FROM requests WHERE op = 'DELETE_USER'",
    "ledger_ttl": f"SELECT * FROM txns WHERE txn_time >= {SQL_AS_OF} - INTERVAL 3600 SECOND",
    "ledger_two": f"""
  SELECT * EXCLUDE (rn) FROM (SELECT *, {_OLDEST} AS rn FROM ledger_ttl)
  WHERE rn > 2 OR txn_time >= {SQL_PRUNE_AS_OF} - INTERVAL 1 MINUTE""",
    "ledger": f"""
  SELECT * EXCLUDE (rn) FROM (SELECT *, {_OLDEST} AS rn FROM ledger_two)
  WHERE (rn > 1 OR txn_time >= {SQL_PRUNE_AS_OF} - INTERVAL 5 MINUTE)
    AND userid NOT IN (SELECT userid FROM gone)""",
    "reserved": f"""
  SELECT * FROM usage WHERE lastdate >= {SQL_AS_OF} - INTERVAL 180 MINUTE AND userid NOT IN (SELECT userid FROM gone)""",
}

_NO = "CAST(NULL AS BIGINT)"


def kept_views(spark, sf):
    """The views after: the state up to three hours; the rest of the log put in; R1 and R2;
    R3; R4; R5 for every user the log asks to delete."""
    state = {"users": fx.users(spark, sf), "usage": fx.usage(spark, sf), "txns": fx.txns(spark, sf),
             "fin_events": fx.fin_events(spark, sf)}
    time = {"usage": "lastdate", "txns": "txn_time", "fin_events": "txn_time"}
    path = os.path.join(ensure_checkpoint_dir(spark), f"kept-{uuid.uuid4().hex}")
    views = I.KeptViews(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    late = F.timestamp_micros(F.lit(PUT_IN_FROM))
    views.apply({"users": I.added(state["users"]),
                 **{k: I.added(state[k].filter(F.col(t) < late)) for k, t in time.items()}})
    views.apply({k: I.added(state[k].filter(F.col(t) >= late)) for k, t in time.items()})

    as_of = fx.RETENTION_AS_OF_US
    views.apply({"usage": I.ttl_usage_changes(state["usage"], as_of),
                 "txns": I.ttl_txns_changes(state["txns"], as_of)})
    state["usage"] = R.ttl_usage(state["usage"], as_of)
    state["txns"] = cut_lineage(R.ttl_txns(state["txns"], as_of))
    views.apply({"txns": I.prune_two_changes(state["txns"], PRUNE_AS_OF)})
    state["txns"] = cut_lineage(R.prune_two(state["txns"], PRUNE_AS_OF))
    views.apply({"txns": I.prune_oldest_changes(state["txns"], PRUNE_AS_OF)})
    state["txns"] = R.prune_oldest(state["txns"], PRUNE_AS_OF)
    doomed = cut_lineage(fx.requests(spark, sf).filter(F.col("op") == "DELETE_USER").select("userid").distinct())
    views.apply(I.delete_users_changes(state, doomed))
    return views


@register("kept_views", f"""
SELECT 'A2' AS view, userid, {_NO} AS sessionid, CAST(sum(amount) AS BIGINT) AS value FROM fin_events GROUP BY userid
UNION ALL SELECT 'A3', {_NO}, {_NO}, CAST(sum(allocated_amount) AS BIGINT) FROM reserved
UNION ALL SELECT 'A4', u.userid, {_NO}, CAST(coalesce(a.s, 0) AS BIGINT)
  FROM users u LEFT JOIN (SELECT userid, sum(allocated_amount) AS s FROM reserved GROUP BY userid) a USING (userid)
  WHERE u.userid NOT IN (SELECT userid FROM gone)
UNION ALL SELECT 'A5', userid, sessionid, count(*) FROM reserved GROUP BY userid, sessionid
UNION ALL SELECT 'A8', userid, {_NO}, count(*) FROM ledger GROUP BY userid""",
          ("users", "usage", "txns", "fin_events", "requests"), extra=_KEPT_CTES)
def kept_views_query(spark, sf):
    """A2-A5 and A8 after batches of insertions, TTL, prunes and deletes, kept by signed changes."""
    v = kept_views(spark, sf)
    no = F.lit(None).cast("long")

    def rows(name, df, value, userid=None, sessionid=no):
        return df.select(F.lit(name).alias("view"), (F.col("userid") if userid is None else userid).alias("userid"),
                         sessionid.alias("sessionid"), F.col(value).alias("value"))
    return (rows("A2", v.user_balance(), "balance")
            .unionByName(rows("A3", v.allocated_credit(), "allocated_amount", no))
            .unionByName(rows("A4", v.user_allocated(), "allocated_amount"))
            .unionByName(rows("A5", v.users_sessions(), "how_many", sessionid=F.col("sessionid")))
            .unionByName(rows("A8", v.cluster_activity_by_users(), "how_many")))


@register("find_by_card_index", """
SELECT e.event_id AS probe_id, u.*
FROM events e JOIN users u
  ON json_extract_string(u.user_json_object, '$.loyaltySchemeNumber') = CAST(e.user_id >> 1 AS VARCHAR)
WHERE e.event_type = 'purchase'""", ("users",))
def find_by_card_index(spark, sf):
    """F2 (bulk) through the index: users by the card shown at each purchase."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"card-index-{uuid.uuid4().hex}")
    index = X.write_card_index(fx.users(spark, sf), path)
    probes = (table(spark, sf, "events", "event_id", "user_id", "event_type").filter(F.col("event_type") == "purchase")
              .select(F.col("event_id").alias("probe_id"), F.shiftright("user_id", 1).alias("card")))
    return X.lookup_cards(index, probes)
