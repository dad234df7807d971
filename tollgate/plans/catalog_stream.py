"""Registered streaming queries: the views' streaming forms
and the add-credit topic flow (S2 -> D9 -> S3 -> A2).  Each writes its input
into an inbox in two halves by time and runs the stream twice from the same
checkpoint, so every result also covers a restart."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators import views as V
from tollgate.plans.registry import register
from tollgate.session import ensure_checkpoint_dir
from tollgate.sources import fixtures as fx
from tollgate.sources import messages as MS
from tollgate.streaming import charge_stream as CS
from tollgate.streaming import views as SV
from tollgate.streaming import windowed_activity as WA


def _root(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _in_two_halves(df: DataFrame, time_col: str, inbox: str, run, held_back: Column | None = None) -> None:
    """Write the rows before the middle of the time range but those ``held_back``,
    run; append the rest, run again.  The midpoint comes from min/max (partial aggregates),
    not from an exact median that would gather every value in one task."""
    t = F.unix_micros(F.col(time_col))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    mid = (lo + hi) // 2 + 1
    first = t < F.lit(mid) if held_back is None else (t < F.lit(mid)) & ~held_back
    for part in (first, ~first):
        df.filter(part).write.mode("append").parquet(inbox)
        run()


@register("user_balance_stream", "SELECT userid, CAST(sum(amount) AS BIGINT) AS balance FROM fin_events GROUP BY userid",
          ("fin_events",))
def user_balance_stream(spark, sf):
    """A2 as a stream: balances kept up to date in update mode, read back as
    the last row per user."""
    root = _root(spark, "balance-stream")
    ev = fx.fin_events(spark, sf)
    inbox, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    _in_two_halves(ev, "txn_time", inbox, lambda: SV.run_to_table(
        SV.user_balance_stream(SV.file_stream(spark, inbox, ev.schema)), out, ck, "update"))
    return SV.latest_per_key(spark, out, "userid")


_ACTIVITY = """
SELECT date_trunc('minute', txn_time) AS txn_time,
       CAST(sum(CASE WHEN spent_amount <= 0 THEN -approved_amount END) AS BIGINT) AS out_approved_amount,
       CAST(sum(CASE WHEN spent_amount <= 0 THEN spent_amount END) AS BIGINT) AS out_spent_amount,
       count(CASE WHEN spent_amount <= 0 THEN 1 END) AS out_how_many,
       CAST(sum(CASE WHEN spent_amount > 0 THEN approved_amount END) AS BIGINT) AS in_approved_amount,
       CAST(sum(CASE WHEN spent_amount > 0 THEN spent_amount END) AS BIGINT) AS in_spent_amount,
       count(CASE WHEN spent_amount > 0 THEN 1 END) AS in_how_many,
       count(*) AS how_many
FROM txns GROUP BY date_trunc('minute', txn_time)"""


@register("activity_per_minute_stream", _ACTIVITY, ("txns",))
def activity_per_minute_stream(spark, sf):
    """A6/A7/A9 as a stream, out of order: a fifth of the first half comes with
    the second half, most of it behind the watermark."""
    root = _root(spark, "activity-stream")
    tx = fx.txns(spark, sf)
    inbox, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    _in_two_halves(tx, "txn_time", inbox, lambda: SV.activity_per_minute_stream(
        SV.file_stream(spark, inbox, tx.schema), out, ck, "10 minutes"),
        held_back=F.pmod(F.xxhash64("user_txn_id"), F.lit(5)) == 0)
    return SV.activity_minutes(spark, out)


@register("activity_windows_stream", _ACTIVITY, ("txns",))
def activity_windows_stream(spark, sf):
    """A6/A7/A9 as event-time windows in the state store, out of order: a fifth
    of the first half comes with the second half, most of it for closed minutes."""
    root = _root(spark, "activity-windows")
    tx = fx.txns(spark, sf)
    inbox, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    _in_two_halves(tx, "txn_time", inbox, lambda: SV.run_to_table(
        WA.activity_windows(SV.file_stream(spark, inbox, tx.schema)), out, ck, "append"),
        held_back=F.pmod(F.xxhash64("user_txn_id"), F.lit(5)) == 0)
    return WA.activity_minutes(spark, out, ck)


@register("credit_topic_balances", """
SELECT userid, CAST(sum(amount) AS BIGINT) AS balance FROM (
  SELECT userid, amount FROM opening_events
  UNION ALL
  SELECT userid, amount FROM (
    SELECT TRY_CAST(trim(split_part(value, ',', 1), '"') AS BIGINT) AS userid,
           TRY_CAST(trim(split_part(value, ',', 2), '"') AS BIGINT) AS amount,
           NULLIF(trim(split_part(value, ',', 3), '"'), '') AS txn_id
    FROM addcredit_msg)
  WHERE userid IS NOT NULL AND amount IS NOT NULL AND txn_id IS NOT NULL
    AND userid IN (SELECT userid FROM users))
GROUP BY userid""", ("opening_events", "addcredit_msg", "users"))
def credit_topic_balances(spark, sf):
    """The add-credit flow: topic messages are decoded (S2, malformed ones
    rejected), replayed by the streaming fold (D9), their financial events
    exported by the stream's per-batch idempotent sink (the S3 design:
    parquet partitioned by batch id, a retried batch replaces itself), and
    balances computed (A2) over the opening events and the exported ones."""
    root = _root(spark, "credit-topic")
    topic = fx.addcredit_topic(spark, sf)
    inbox, out, state = (os.path.join(root, x) for x in ("in", "out", "state"))
    users, opening = fx.users(spark, sf), fx.opening_events(spark, sf)

    def run():
        msgs = SV.file_stream(spark, inbox, topic.schema)
        reqs = MS.addcredit_requests(msgs, time_col="timestamp", id_col="offset")
        CS.run_available(reqs, out, state, users=users, opening_events=opening)

    _in_two_halves(topic, "timestamp", inbox, run)
    exported = CS.events_of(CS.read_charge_outputs(spark, out)).select("userid", "amount")
    return V.user_balance(opening.select("userid", "amount").unionByName(exported))


@register("late_requests", """
SELECT r.* FROM requests r
JOIN (SELECT userid, max(struct_pack(t := txn_time, i := request_id)) AS last FROM requests
      WHERE request_id % 5 <> 0 GROUP BY userid) f ON f.userid = r.userid
WHERE r.request_id % 5 = 0 AND struct_pack(t := r.txn_time, i := r.request_id) <= f.last""", ("requests",))
def late_requests(spark, sf):
    """D9's late output: every fifth request comes after all others; those
    older than their user's state are returned with all their columns."""
    root = _root(spark, "late-requests")
    req = fx.requests(spark, sf)
    inbox, out, state = (os.path.join(root, x) for x in ("in", "out", "state"))
    for part in (F.col("request_id") % 5 != 0, F.col("request_id") % 5 == 0):
        req.filter(part).write.mode("append").parquet(inbox)
        CS.run_available(CS.request_stream(spark, inbox), out, state, users=fx.known_users(spark, sf),
                         opening_events=fx.known_opening(spark, sf))
    return CS.late_of(CS.read_charge_outputs(spark, out))
