"""Point lookups of the procedures (F1-F8) in point and bulk form.

The reference looks up one user per call; on Spark the same operators take a
DataFrame of probe keys and run as one join.  Spark picks the strategy
(sort-merge for large sides); with ``session.CLUSTER_CONF`` a broadcast
happens only after AQE has measured the smaller side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.columns import json_is_object, loyalty_delta_update, loyalty_number_text
from tollgate.functions.texts import text_col
from tollgate.operators.keyed import later_than_first


def _filter_ids(df: DataFrame, ids, col: str = "userid") -> DataFrame:
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
    if isinstance(ids, (int,)):
        return df.filter(F.col(col) == ids)
    return df.filter(F.col(col).isin(list(ids)))


def user_by_id(users: DataFrame, ids) -> DataFrame:
    """users whose id is in ``ids`` (an id, a list, or a DataFrame whose
    first column holds ids).  A list becomes an IN filter pushed to the scan."""
    return _filter_ids(users, ids)


def find_by_loyalty_card(users: DataFrame, cards) -> DataFrame:
    """users whose JSON field loyaltySchemeNumber equals the card number
    compared as text.  ``cards`` is a number, a list, or a DataFrame with
    columns (probe_id, card); the bulk form returns (probe_id, user columns)."""
    key = loyalty_number_text("user_json_object")
    if isinstance(cards, DataFrame):
        probe_id, card = cards.columns[0], cards.columns[1]
        probes = cards.select(F.col(probe_id).alias("probe_id"), F.col(card).cast("string").alias("_card"))
        keyed = users.withColumn("_card", key).filter(F.col("_card").isNotNull())
        return probes.join(keyed, "_card").drop("_card")
    if isinstance(cards, Iterable) and not isinstance(cards, (str, bytes)):
        return users.filter(key.isin([str(c) for c in cards]))
    return users.filter(key == F.lit(str(cards)))


def show_transactions(txns: DataFrame, ids=None) -> DataFrame:
    """ledger rows of users, ordered by (userid, txn_time, user_txn_id)."""
    return _filter_ids(txns, ids).orderBy("userid", "txn_time", "user_txn_id")


def user_txn_ids(txns: DataFrame, ids=None) -> DataFrame:
    """(txn id, time) of users' ledger rows in the same order."""
    return (_filter_ids(txns, ids).select("userid", "user_txn_id", "txn_time")
            .orderBy("userid", "txn_time", "user_txn_id"))


def user_sessions_of(usage: DataFrame, ids=None) -> DataFrame:
    """reservations of users ordered by session id."""
    return _filter_ids(usage, ids).orderBy("userid", "sessionid")


def unknown_user_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests whose user does not exist in a static user set."""
    return requests.join(users.select("userid"), "userid", "left_anti")


def duplicate_requests(requests: DataFrame, key_col: str = "txn_id") -> DataFrame:
    """F7 (infinite horizon): requests whose (userid, txn id) was seen before,
    in (txn_time, request_id) order.  Requests without a txn id never count.
    Finite-horizon duplicates are decided by the charging fold."""
    keyed = requests.filter(F.col(key_col).isNotNull())
    return later_than_first(keyed, ["userid", key_col], ["txn_time", "request_id"])


def duplicates_of_ledger(requests: DataFrame, txns: DataFrame) -> DataFrame:
    """F7 against a stored ledger: requests whose txn id is already recorded."""
    return requests.join(txns.select("userid", F.col("user_txn_id").alias("txn_id")),
                         ["userid", "txn_id"], "left_semi")


def loyalty_delta(users: DataFrame, updates: DataFrame) -> DataFrame:
    """F8 in bulk: apply NEW_LOYALTY_NUMBER deltas (updates: request_id,
    userid, json payload) to the users' JSON.  ``new_json`` is NULL and
    ``error`` set when the payload is not a number or the stored JSON cannot
    be parsed (the reference aborts those calls)."""
    j = users.select("userid", "user_json_object").join(
        updates.select("request_id", "userid", F.col("json").alias("payload")), "userid")
    new = loyalty_delta_update("user_json_object", "payload")
    null_text = lambda c: F.coalesce(F.col(c), F.lit("null"))  # noqa: E731  (Java prints null)
    return j.select(
        "request_id", "userid", "payload", new.alias("new_json"),
        F.when(new.isNull(), F.when(~json_is_object("user_json_object"),
                                     text_col(S.TEXT_BAD_JSON, userid="userid", old=null_text("user_json_object"),
                                              payload=null_text("payload")))
               .otherwise(text_col(S.TEXT_BAD_NUMBER, payload=null_text("payload")))).alias("error"))
