"""The reference's views (A1-A12) as DataFrame functions.

Every aggregate is count/sum/min/max, so Spark computes each with a partial
(map-side) aggregate followed by a final one: a hot user or a hot minute is
collapsed before the shuffle.  ``activity_per_minute`` computes A6, A7 and
A9 in one pass with conditional aggregates (used by M2 and M3); the single
view functions give each view alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.columns import minute_trunc, null_default


def current_locks(users: DataFrame, as_of=None, mode: str = "reference") -> DataFrame:
    """A1: users holding a soft lock.  ``reference`` counts every non-NULL
    expiry, expired ones included (Q8); ``strict`` only those after ``as_of``."""
    cond = F.col("user_softlock_expiry").isNotNull()
    if mode == "strict":
        from tollgate.functions.columns import ts_literal
        cond = cond & (F.col("user_softlock_expiry") > ts_literal(as_of))
    return users.filter(cond).agg(F.count(F.lit(1)).alias("how_many"))


def user_balance(fin_events: DataFrame) -> DataFrame:
    """A2: balance per user = sum of all financial events."""
    return fin_events.groupBy("userid").agg(F.sum("amount").alias("balance"))


def allocated_credit(usage: DataFrame) -> DataFrame:
    """A3: total reserved credit; NULL when there are no reservations (Q15)."""
    return usage.agg(F.sum("allocated_amount").alias("allocated_amount"))


def user_allocated(users: DataFrame, usage: DataFrame) -> DataFrame:
    """A4: reserved credit per user, 0 when none (nvl(sum, 0)).  The usage side
    is aggregated first, so the join sees one row per user on both sides."""
    per_user = usage.groupBy("userid").agg(F.sum("allocated_amount").alias("allocated_amount"))
    return (users.select("userid").join(per_user, "userid", "left")
            .select("userid", null_default("allocated_amount").alias("allocated_amount")))


def users_sessions(usage: DataFrame) -> DataFrame:
    """A5: reservation rows per (userid, sessionid)."""
    return usage.groupBy("userid", "sessionid").agg(F.count(F.lit(1)).alias("how_many"))


def activity_per_minute(txns: DataFrame) -> DataFrame:
    """One pass over the ledger with conditional aggregates: per minute, the
    'out' figures (spent <= 0), the 'in' figures (spent > 0) and all rows."""
    out = F.col("spent_amount") <= 0
    inn = F.col("spent_amount") > 0
    return (txns.select(minute_trunc("txn_time").alias("txn_time"), "approved_amount", "spent_amount")
            .groupBy("txn_time").agg(
                F.sum(F.when(out, -F.col("approved_amount"))).alias("out_approved_amount"),
                F.sum(F.when(out, F.col("spent_amount"))).alias("out_spent_amount"),
                F.count(F.when(out, F.lit(1))).alias("out_how_many"),
                F.sum(F.when(inn, F.col("approved_amount"))).alias("in_approved_amount"),
                F.sum(F.when(inn, F.col("spent_amount"))).alias("in_spent_amount"),
                F.count(F.when(inn, F.lit(1))).alias("in_how_many"),
                F.count(F.lit(1)).alias("how_many")))


def recent_activity_out(txns: DataFrame) -> DataFrame:
    """Per minute sum(-approved), sum(spent), count where spent <= 0.  A
    zero-amount credit counts here (Q12); NULL spent falls in neither view."""
    return (txns.filter(F.col("spent_amount") <= 0)
            .groupBy(minute_trunc("txn_time").alias("txn_time"))
            .agg(F.sum(-F.col("approved_amount")).alias("approved_amount"),
                 F.sum("spent_amount").alias("spent_amount"),
                 F.count(F.lit(1)).alias("how_many")))


def recent_activity_in(txns: DataFrame) -> DataFrame:
    """Per minute sum(approved), sum(spent), count where spent > 0."""
    return (txns.filter(F.col("spent_amount") > 0)
            .groupBy(minute_trunc("txn_time").alias("txn_time"))
            .agg(F.sum("approved_amount").alias("approved_amount"),
                 F.sum("spent_amount").alias("spent_amount"),
                 F.count(F.lit(1)).alias("how_many")))


def cluster_activity_by_users(txns: DataFrame) -> DataFrame:
    """Ledger rows per user."""
    return txns.groupBy("userid").agg(F.count(F.lit(1)).alias("how_many"))


def cluster_activity(txns: DataFrame) -> DataFrame:
    """Ledger rows per minute."""
    return (txns.groupBy(minute_trunc("txn_time").alias("txn_time"))
            .agg(F.count(F.lit(1)).alias("how_many")))


def last_cluster_activity(txns: DataFrame) -> DataFrame:
    """A10: time of the latest ledger row."""
    return txns.agg(F.max("txn_time").alias("txn_time"))


def cluster_users(users: DataFrame) -> DataFrame:
    """Number of users."""
    return users.agg(F.count(F.lit(1)).alias("how_many"))


def user_id_range(users: DataFrame) -> DataFrame:
    """Lowest and highest user id, with the message printed when there
    are no users."""
    return (users.agg(F.min("userid").alias("min_userid"), F.max("userid").alias("max_userid"))
            .withColumn("message", F.when(F.col("min_userid").isNull(), F.lit(S.TEXT_NO_USERS))))
