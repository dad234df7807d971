"""Account checks the reference's clients make on every answer (C1-C6), run
in bulk over state tables and decision logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.operators.views import user_balance


def spendable_balance(fin_events: DataFrame, usage: DataFrame) -> DataFrame:
    """Per user with a balance: balance - reserved (no reservation = 0).
    Both sides are aggregated per user before the join."""
    bal = user_balance(fin_events)
    res = usage.groupBy("userid").agg(F.sum("allocated_amount").alias("reserved"))
    return (bal.join(res, "userid", "left")
            .select("userid", "balance", F.coalesce("reserved", F.lit(0)).cast("long").alias("reserved"),
                    (F.col("balance") - F.coalesce("reserved", F.lit(0))).cast("long").alias("spendable")))


def negative_balance_audit(spendable: DataFrame) -> DataFrame:
    """Users whose spendable balance is below zero ("should never see")."""
    return spendable.filter(F.col("spendable") < 0)


def negative_after_decision(decisions: DataFrame) -> DataFrame:
    """C2 on a decision log: answers that left balance - allocated below 0."""
    return decisions.filter((F.col("balance_after") - F.col("allocated_after")) < 0)


def missing_balance_audit(users: DataFrame, fin_events: DataFrame) -> DataFrame:
    """Users without a balance row (no financial event at all).  The event
    side is reduced to distinct user ids first (partial aggregation), so a user
    with very many events does not make one join partition huge."""
    return users.select("userid").join(fin_events.select("userid").distinct(), "userid", "left_anti")


def topup_candidates(spendable: DataFrame, threshold: int = S.TOPUP_THRESHOLD) -> DataFrame:
    """C4: users whose spendable balance is below ``threshold``."""
    return spendable.filter(F.col("spendable") < threshold)


def status_mix(decisions: DataFrame) -> DataFrame:
    """Decisions per (op, status) with a flag for statuses the operation is
    not expected to return."""
    expected = F.lit(False)
    for op, codes in S.EXPECTED_STATUSES.items():
        expected = expected | ((F.col("op") == op) & F.col("status").isin(list(codes)))
    return (decisions.groupBy("op", "status").agg(F.count(F.lit(1)).alias("how_many"))
            .withColumn("unexpected", ~expected))


def lock_contention(decisions: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per user lock attempts, lock conflicts, successful full and delta
    updates and failed updates.  Delta vs full needs the request's delta_op,
    taken from ``requests`` when given (joined on request_id)."""
    d = decisions.filter(F.col("op").isin("LOCK_USER", "UPDATE_USER"))
    if requests is not None:
        updates = requests.filter(F.col("op") == "UPDATE_USER").select("request_id", "delta_op")
        d = d.join(updates, "request_id", "left")
    else:
        d = d.withColumn("delta_op", F.lit(None).cast("string"))
    lock = F.col("op") == "LOCK_USER"
    upd = F.col("op") == "UPDATE_USER"
    ok = F.col("status") == S.STATUS_OK
    delta = F.col("delta_op") == S.NEW_LOYALTY_NUMBER
    return d.groupBy("userid").agg(
        F.count(F.when(lock, 1)).alias("lock_attempts"),
        F.count(F.when(lock & (F.col("status") == S.STATUS_RECORD_ALREADY_SOFTLOCKED), 1)).alias("lock_failures"),
        F.count(F.when(upd & ok & ~F.coalesce(delta, F.lit(False)), 1)).alias("full_updates"),
        F.count(F.when(upd & ok & F.coalesce(delta, F.lit(False)), 1)).alias("delta_updates"),
        F.count(F.when(upd & ~ok, 1)).alias("update_failures"))
