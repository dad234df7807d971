"""Value-at-risk metrics and the dashboard series (M1-M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.columns import date_shift, micros, minute_trunc, ts_literal
from tollgate.operators import views as V

_LOCKS, _COUNT, _ALLOCATED = S.METRIC_NAMES[:3]
_MINUTE_STATS = S.METRIC_NAMES[3:]


def _stat(df: DataFrame, name: str, col: str) -> DataFrame:
    return df.select(F.lit(name).alias("statname"), F.lit(name).alias("stathelp"),
                     F.col(col).cast("long").alias("statvalue"))


def current_metrics(users: DataFrame, usage: DataFrame, txns: DataFrame, as_of) -> DataFrame:
    """M1: the eight statistics of the metrics procedure.  The minute figures
    are for the minute before ``as_of`` and are absent when that minute had no
    activity of their kind; there is no 'in approved' statistic.  The minute
    is selected with a range filter on txn_time (pushed to the scan) before
    the one conditional aggregate."""
    minute = minute_trunc(date_shift(ts_literal(as_of), minutes=-1))
    rows = txns.filter((F.col("txn_time") >= minute) & (F.col("txn_time") < date_shift(minute, minutes=1)))
    out = F.col("spent_amount") <= 0
    inn = F.col("spent_amount") > 0
    o_appr, o_spent, o_qty, i_spent, i_qty = _MINUTE_STATS
    act = rows.agg(
        F.sum(F.when(out, -F.col("approved_amount"))).alias(o_appr),
        F.sum(F.when(out, F.col("spent_amount"))).alias(o_spent),
        F.count(F.when(out, F.lit(1))).alias(o_qty),
        F.sum(F.when(inn, F.col("spent_amount"))).alias(i_spent),
        F.count(F.when(inn, F.lit(1))).alias(i_qty))
    # a minute statistic exists only when its view has a row for that minute
    present = {o_appr: o_qty, o_spent: o_qty, o_qty: o_qty, i_spent: i_qty, i_qty: i_qty}
    stack = "stack(5, " + ", ".join(f"'{n}', cast({n} as bigint), {present[n]}" for n in _MINUTE_STATS) \
        + ") as (statname, statvalue, present)"
    minute_rows = (act.selectExpr(stack).filter(F.col("present") > 0)
                   .select("statname", F.col("statname").alias("stathelp"), "statvalue"))
    gauges = user_lock_gauges(users).selectExpr(
        f"stack(2, '{_LOCKS}', user_locks, '{_COUNT}', user_count) as (statname, statvalue)")
    return (gauges.select("statname", F.col("statname").alias("stathelp"), F.col("statvalue").cast("long"))
            .unionByName(_stat(V.allocated_credit(usage), _ALLOCATED, "allocated_amount"))
            .unionByName(minute_rows))


def credit_flow_per_minute(txns: DataFrame) -> DataFrame:
    """M2: per minute the credit added (in spent), the credit approved and the
    credit spent, both turned positive (the 'out' view stores them negative).
    NULL where the minute has no rows of that kind (as the outer join of the
    two views would give)."""
    act = V.activity_per_minute(txns)
    return act.select("txn_time",
                      F.col("in_spent_amount").alias("added"),
                      (-F.col("out_approved_amount")).alias("approved"),
                      (-F.col("out_spent_amount")).alias("spent"))


def calls_per_minute(txns: DataFrame) -> DataFrame:
    """M3: per minute the number of credit rows (in) and usage rows (out)."""
    act = V.activity_per_minute(txns)
    return act.select("txn_time", F.col("in_how_many").alias("add_credit_calls"),
                      F.col("out_how_many").alias("report_usage_calls"))


def user_lock_gauges(users: DataFrame) -> DataFrame:
    """M4: registered and locked users in one row (one pass over users)."""
    return users.agg(F.count(F.lit(1)).alias("user_count"),
                     F.count(F.col("user_softlock_expiry")).alias("user_locks"))


def allocated_series(decisions: DataFrame) -> DataFrame:
    """M5: total reserved credit at the end of each minute with decisions.
    Each decision carries the user's reservation total after it.  A user's
    changes within a minute telescope, so only its last total per minute is
    needed: a partial aggregate per (user, minute) (skew-safe), then the
    change against the user's previous active minute (a window over at most
    one row per minute), summed per minute and accumulated over minutes.
    Expiry shows at the user's next request."""
    per_um = (decisions.filter(F.col("allocated_after").isNotNull())
              .groupBy("userid", minute_trunc("txn_time").alias("minute"))
              .agg(F.max_by("allocated_after", F.struct("txn_time", "request_id")).alias("last")))
    w = Window.partitionBy("userid").orderBy("minute")
    per_minute = (per_um.select("minute", (F.col("last") - F.coalesce(F.lag("last").over(w), F.lit(0))).alias("d"))
                  .groupBy("minute").agg(F.sum("d").alias("delta")))
    run = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return per_minute.select(F.col("minute").alias("txn_time"),
                             F.sum("delta").over(run).cast("long").alias("allocated_amount"))


def value_at_risk_series(decisions: DataFrame) -> DataFrame:
    """M5/A3 with expiry when it happens: total reserved credit at the end of
    each minute in which some reservation opens or closes.

    A reservation opens with its decision and closes at the next report of its
    session, the user's deletion, or 180 minutes on, whichever comes first; its
    amount enters the minutes of both as a signed change, and the changes are
    summed over the minutes.  What closes it lies in its own 180-minute bucket or
    the next, so rows are copied into the bucket before and the windows see one
    (user, bucket): a hot user is split by time, with one shuffle."""
    ttl = F.lit(S.USAGE_TTL_MINUTES * 60 * 1_000_000)
    delete = F.col("op") == "DELETE_USER"
    touches = (F.col("op") == "REPORT_USAGE") & F.col("status").between(S.STATUS_OK, S.STATUS_ALL_UNITS_ALLOCATED)
    rows = (decisions.where(touches | delete).withColumn("t", micros("txn_time"))
            .select("userid", "session_id", "request_id", "t", delete.alias("gone"), "approved")
            .withColumn("bucket", F.floor(F.col("t") / ttl)))
    rows = rows.withColumn("ctx", F.lit(False)).unionByName(
        rows.withColumn("bucket", F.col("bucket") - 1).withColumn("ctx", F.lit(True)))
    user = Window.partitionBy("userid", "bucket").orderBy("t", "request_id")
    session = Window.partitionBy("userid", "bucket", "session_id").orderBy("t", "request_id")
    deleted = F.min(F.when(F.col("gone"), F.col("t"))).over(user.rowsBetween(1, Window.unboundedFollowing))
    rows = (rows.withColumn("deleted", deleted).withColumn("touched", F.lead("t").over(session))
            .where(~F.col("ctx") & ~F.col("gone") & (F.col("approved") != 0)))
    closes = F.least("touched", "deleted", F.col("t") + ttl)
    changes = rows.select(F.explode(F.array(F.struct(F.col("t").alias("at"), F.col("approved").alias("by")),
                                            F.struct(closes.alias("at"), (-F.col("approved")).alias("by")))).alias("c"))
    per_minute = (changes.groupBy(minute_trunc(F.timestamp_micros("c.at")).alias("txn_time"))
                  .agg(F.sum("c.by").alias("by")))
    run = Window.orderBy("txn_time").rowsBetween(Window.unboundedPreceding, 0)     # a row per minute
    return per_minute.select("txn_time", F.sum("by").over(run).cast("long").alias("allocated_amount"))


def procedure_rate(requests: DataFrame, ops=("LOCK_USER", "UPDATE_USER")) -> DataFrame:
    """M6: calls per second of the lock and update procedures per minute
    (count / 60), minutes with calls only."""
    return (requests.filter(F.col("op").isin(list(ops)))
            .groupBy(minute_trunc("txn_time").alias("txn_time"), "op")
            .agg((F.count(F.lit(1)) / F.lit(60.0)).alias("per_second"))
            .filter(F.col("per_second") > 0))
