"""Ordered selections: V5a, V5b, T1, T2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.columns import date_shift, ts_literal
from tollgate.operators.keyed import first_per_key, top_k_per_key
from tollgate.operators.views import users_sessions


def multi_session_ref(usage: DataFrame, limit: int = 50) -> DataFrame:
    """Rows of users_sessions with how_many > 1, ordered by (how_many,
    userid, sessionid), first ``limit``.  Empty on keyed reservations (Q6).
    Spark plans orderBy+limit as a per-partition top-k merged once."""
    return (users_sessions(usage).filter(F.col("how_many") > 1)
            .orderBy("how_many", "userid", "sessionid").limit(limit))


def multi_session_users(usage: DataFrame, limit: int = 50) -> DataFrame:
    """What the procedure was meant to find - users holding more than one
    session - ordered by (sessions, userid), first ``limit``."""
    return (usage.groupBy("userid").agg(F.countDistinct("sessionid").alias("how_many"))
            .filter(F.col("how_many") > 1).orderBy("how_many", "userid").limit(limit))


def oldest_txn_per_user(txns: DataFrame) -> DataFrame:
    """Each user's oldest ledger row by (txn_time, user_txn_id), via a
    partial min(struct) aggregate (no per-user sort)."""
    return first_per_key(txns, ["userid"], ["txn_time", "user_txn_id"],
                         ["sessionid", "approved_amount", "spent_amount", "purpose"])


def two_oldest_stale_txns(txns: DataFrame, as_of, k: int = 2,
                          age_seconds: int = S.PRUNE_TWO_AGE_SECONDS) -> DataFrame:
    """Per user the ``k`` oldest ledger rows older than ``age_seconds``
    before ``as_of`` (strict), order (txn_time, user_txn_id).  Salted two-stage
    ranking keeps a hot user spread over many tasks."""
    cutoff = date_shift(ts_literal(as_of), seconds=-age_seconds)
    stale = txns.filter(F.col("txn_time") < cutoff)
    return top_k_per_key(stale, ["userid"], ["txn_time", "user_txn_id"], k, salt_col="user_txn_id")
