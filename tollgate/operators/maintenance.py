"""Retention and deletes.

Parquet has no row TTL and no MERGE, so each operation returns the new
snapshot ``f(old, as_of)``; the caller writes it to a new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.columns import date_shift, ts_literal
from tollgate.operators.topk import oldest_txn_per_user, two_oldest_stale_txns


def ttl_usage(usage: DataFrame, as_of, minutes: int = S.USAGE_TTL_MINUTES) -> DataFrame:
    """Keep reservations whose lastdate is not older than ``minutes``
    before ``as_of``; dropping a reservation releases its credit."""
    return usage.filter(F.col("lastdate") >= date_shift(ts_literal(as_of), minutes=-minutes))


def ttl_txns(txns: DataFrame, as_of, seconds: int = S.TXN_TTL_SECONDS) -> DataFrame:
    """R2: keep ledger rows not older than ``seconds`` before ``as_of``."""
    return txns.filter(F.col("txn_time") >= date_shift(ts_literal(as_of), seconds=-seconds))


def prune_two(txns: DataFrame, as_of) -> DataFrame:
    """Delete each user's two oldest rows older than one minute (T2).  The
    anti join is on (userid, user_txn_id), so a hot user spreads over tasks."""
    doomed = two_oldest_stale_txns(txns, as_of).select("userid", "user_txn_id")
    return txns.join(doomed, ["userid", "user_txn_id"], "left_anti")


def prune_oldest(txns: DataFrame, as_of, age_seconds: int = S.PRUNE_OLDEST_AGE_SECONDS) -> DataFrame:
    """Delete each user's oldest row (T1) when it is older than five
    minutes before ``as_of``."""
    cutoff = date_shift(ts_literal(as_of), seconds=-age_seconds)
    doomed = oldest_txn_per_user(txns).filter(F.col("txn_time") < cutoff).select("userid", "user_txn_id")
    return txns.join(doomed, ["userid", "user_txn_id"], "left_anti")


def delete_users(state: dict[str, DataFrame], ids=None, id_range: tuple[int, int] | None = None
                 ) -> dict[str, DataFrame]:
    """Remove users from every state table (users, usage, txns, balances).
    Exported financial events stay (Q18).  ``ids`` is a list (IN filter) or a
    DataFrame of ids (anti join); ``id_range`` deletes an inclusive range."""
    out = {}
    for name, df in state.items():
        if name == "fin_events":
            out[name] = df
            continue
        if id_range is not None:
            lo, hi = id_range
            df = df.filter(~F.col("userid").between(lo, hi))
        if ids is not None:
            if isinstance(ids, DataFrame):
                df = df.join(ids.select(F.col(ids.columns[0]).alias("userid")), "userid", "left_anti")
            else:
                df = df.filter(~F.col("userid").isin(list(ids) if not isinstance(ids, int) else [ids]))
        out[name] = df
    return out


def clear_reservations(usage: DataFrame) -> DataFrame:
    """Delete all reservations (an empty snapshot with the same schema)."""
    return usage.limit(0)


def unlock_all(users: DataFrame) -> DataFrame:
    """Clear both lock columns of users whose lock session is set."""
    locked = F.col("user_softlock_sessionid").isNotNull()
    return users.select(
        "userid", "user_json_object", "user_last_seen",
        F.when(locked, F.lit(None).cast("long")).otherwise(F.col("user_softlock_sessionid"))
         .alias("user_softlock_sessionid"),
        F.when(locked, F.lit(None).cast("timestamp")).otherwise(F.col("user_softlock_expiry"))
         .alias("user_softlock_expiry"))


__all__ = ["ttl_usage", "ttl_txns", "prune_two", "prune_oldest", "delete_users",
           "clear_reservations", "unlock_all"]
