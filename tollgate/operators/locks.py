"""D6, D7 and C6 without the replay: lock and update requests decided by windows
and joins, no Python.

What decides them is little: the user's existence (last sign-up or delete), the
lock, and whether the stored JSON is an object.  Money never enters.

1. Existence, and the delete that a request comes after (its *life*): carried
   from the last row that sets them.
2. A lock request at least 50 ms behind the user's lock request before it is
   granted, whatever came earlier: it *starts* an island.  Within an island each
   lock request, were it granted, points to the one granted after it: the first
   one behind its expiry or behind its own session's update, whichever is first.
   Following these pointers from the starts marks all grants; pointers are doubled
   in each round, so a chain of n grants takes log2(n) rounds of joins.
3. An update is accepted where the last grant before it is its own session's, or
   was given back before it, or there is none.
4. A card-number update on JSON that is no object fails and gives nothing back.
   Which ones those are follows from the updates accepted before, so steps 2 to 4
   are repeated with the failures found until they stay the same.  Every row
   depends on earlier rows only, so what stays the same is the replay's answer;
   without bad JSON one round does.

A user's rows are never one window: values are carried within minutes of a user,
and over its minutes by one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tollgate import schema as S
from tollgate.functions.columns import json_is_object, micros, parse_long_strict
from tollgate.functions.texts import text_col
from tollgate.session import cut_lineage

BUCKET_US = 60 * 1_000_000
LOCK_US = S.LOCK_TIMEOUT_MS * 1000
#: position of what was there before the log
START = -(1 << 62)
POSITION = ("t", "id")


def carry(rows: DataFrame, values: dict[str, Column], after: bool = False) -> DataFrame:
    """``rows`` (userid, t, id, ...) with, for every name, the last value of that
    column that is not null on the user's rows before this one (``after``: the
    first behind it)."""
    pick = F.min_by if after else F.max_by
    way = (lambda c: F.col(c).desc()) if after else F.col
    names = list(values)
    keyed = rows.withColumn("__b", F.expr(f"t div {BUCKET_US}"))
    for n in names:
        keyed = keyed.withColumn(f"__{n}", values[n])
    ends = keyed.groupBy("userid", "__b").agg(*[
        pick(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.struct(*POSITION))).alias(f"__{n}") for n in names])
    over = Window.partitionBy("userid").orderBy(way("__b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("userid", "__b", *[F.last(f"__{n}", ignorenulls=True).over(over).alias(f"__{n}_in") for n in names])
    within = (Window.partitionBy("userid", "__b").orderBy(*[way(c) for c in POSITION])
              .rowsBetween(Window.unboundedPreceding, -1))
    return keyed.join(ends, ["userid", "__b"], "left").select(*rows.columns, *[
        F.coalesce(F.last(f"__{n}", ignorenulls=True).over(within), F.col(f"__{n}_in")).alias(n) for n in names])


def _rows(requests: DataFrame, users: DataFrame | None) -> DataFrame:
    """Lock, update, sign-up and delete requests and the users there before, with
    ``alive``, ``life`` and whether the row creates the user."""
    op = F.col("op")
    rows = requests.where(op.isin("LOCK_USER", "UPDATE_USER", "DELETE_USER")
                          | ((op == "UPSERT_USER") & F.col("txn_id").isNotNull())).select(
        "userid", micros("txn_time").alias("t"), F.col("request_id").alias("id"), "op", "session_id", "json", "delta_op",
        F.lit(None).cast("long").alias("expiry"))
    if users is not None:
        rows = rows.unionByName(users.select(
            "userid", F.lit(START).cast("long").alias("t"), F.lit(START).cast("long").alias("id"), F.lit("USER").alias("op"),
            F.col("user_softlock_sessionid").alias("session_id"), F.col("user_json_object").alias("json"),
            F.lit(None).cast("string").alias("delta_op"), micros("user_softlock_expiry").alias("expiry")))
    deletes = op == "DELETE_USER"
    rows = carry(rows, {"alive": F.when(op.isin("USER", "UPSERT_USER"), F.lit(True)).when(deletes, F.lit(False)),
                        "life": F.when(deletes, F.struct(*POSITION))})
    beginning = F.struct(F.lit(START).cast("long").alias("t"), F.lit(START).cast("long").alias("id"))
    rows = (rows.withColumn("alive", F.coalesce("alive", F.lit(False)) | (op == "USER"))
            .withColumn("life", F.coalesce("life", beginning)))
    delta = F.coalesce(F.col("delta_op") == S.NEW_LOYALTY_NUMBER, F.lit(False))
    return (rows.withColumn("delta", delta)
            .withColumn("number_ok", ~delta | parse_long_strict("json").isNotNull()))


def _holders(rows: DataFrame) -> DataFrame:
    """Whatever can hold a lock: lock requests of users that are there, and locks
    from before the log; ``start`` marks those that hold it in any case."""
    op = F.col("op")
    some = rows.where((F.col("alive") & (op == "LOCK_USER")) | ((op == "USER") & F.col("expiry").isNotNull()))
    is_lock = op == "LOCK_USER"
    some = carry(some, {"prev": F.when(is_lock, F.struct("t", "life")), "held": F.when(~is_lock, F.struct("expiry", "life"))})
    free = F.col("prev").isNull() | (F.col("prev.life") != F.col("life")) | (F.col("t") - F.col("prev.t") >= LOCK_US)
    held = F.coalesce((F.col("held.life") == F.col("life")) & (F.col("t") < F.col("held.expiry")), F.lit(False))
    return some.select("userid", *POSITION, "life", F.when(is_lock, F.col("id")).otherwise(F.col("session_id")).alias("holder"),
                       F.when(is_lock, F.col("t") + LOCK_US).otherwise(F.col("expiry")).alias("expiry"),
                       is_lock.alias("is_lock"), (~is_lock | (free & ~held)).alias("start"))


def _grants(holders: DataFrame, updates: DataFrame) -> DataFrame:
    """The holders that get the lock, with ``back``: where their session's first
    update that succeeds gives it back.  ``updates``: the ones that can succeed."""
    u = updates.select(F.col("userid").alias("u_user"), F.col("session_id").alias("u_session"), F.col("life").alias("u_life"),
                       F.struct(*POSITION).alias("at"))
    back = (holders.join(u, (F.col("userid") == F.col("u_user")) & F.col("holder").eqNullSafe(F.col("u_session"))
                         & (F.col("life") == F.col("u_life")) & (F.col("at") > F.struct(*POSITION)))
            .groupBy("userid", "id").agg(F.min("at").alias("back")))
    holders = cut_lineage(holders.join(back, ["userid", "id"], "left"))

    # from where on the next lock request is granted, and which one that is
    expired = F.struct(F.col("expiry").alias("t"), F.lit(START).cast("long").alias("id"))
    until = F.when(F.col("back") < expired, F.col("back")).otherwise(expired)
    none = F.lit(None).cast(T.StructType([T.StructField("id", T.LongType()), T.StructField("life", holders.schema["life"].dataType),
                                          T.StructField("start", T.BooleanType())]))
    probes = holders.withColumn("until", until).select(
        "userid", F.col("until.t").alias("t"), F.col("until.id").alias("id"), F.col("id").alias("of"), "life", none.alias("lock"))
    found = holders.where("is_lock").select("userid", *POSITION, F.lit(None).cast("long").alias("of"), "life",
                                            F.struct("id", "life", "start").alias("lock"))
    hops = carry(probes.unionByName(found), {"next": F.col("lock")}, after=True).where(
        F.col("of").isNotNull() & (F.col("next.life") == F.col("life")) & ~F.col("next.start"))
    hops = cut_lineage(hops.select("userid", F.col("of").alias("id"), F.col("next.id").alias("next")))

    marked = holders.where("start").select("userid", "id")
    while not hops.isEmpty():
        new = cut_lineage(hops.join(marked, ["userid", "id"], "left_semi").select("userid", F.col("next").alias("id")).distinct())
        if new.isEmpty():
            break
        marked = cut_lineage(marked.unionByName(new))
        on = hops.select("userid", F.col("id").alias("next"), F.col("next").alias("after"))
        hops = cut_lineage(hops.join(on, ["userid", "next"]).select("userid", "id", F.col("after").alias("next")))
    return holders.join(marked, ["userid", "id"], "left_semi")


def _decide(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """``rows`` with the lock that is held (or was last) and, for updates, what
    they meet: ``accepted``, ``old`` (the JSON) and ``fails`` (it is no object)."""
    g = grants.select("userid", "id", F.struct("holder", "expiry", "life", "back").alias("grant"))
    rows = carry(rows.join(g, ["userid", "id"], "left"), {"lock": F.col("grant")})
    here = F.struct(*POSITION)
    op = F.col("op")
    rows = rows.withColumn("lock", F.when(F.col("lock.life") == F.col("life"), F.col("lock")))
    rows = rows.withColumn("accepted", (op == "UPDATE_USER") & F.col("alive") & (
        F.col("lock").isNull() | F.coalesce(F.col("lock.back") < here, F.lit(False))
        | F.col("lock.holder").eqNullSafe(F.col("session_id"))))
    sets = (op == "USER") | ((op == "UPSERT_USER") & ~F.col("alive")) | (F.col("accepted") & ~F.col("delta"))
    rows = carry(rows, {"old": F.when(sets, F.struct("json"))}).withColumn("old", F.col("old.json"))
    return rows.withColumn("fails", F.col("accepted") & F.col("delta") & ~json_is_object("old"))


def lock_decisions(requests: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The decisions of all LOCK_USER and UPDATE_USER requests of a log: request_id,
    userid, txn_time, op, status, status_text, session_id, as ``charge`` in either
    mode gives them.  ``users`` is the state before the log; without it nobody is
    there.  Request ids must be unique and a null time comes in no order.  Several
    steps are stored by reliable checkpoints in the shared folder."""
    rows = cut_lineage(_rows(requests, users))
    holders = cut_lineage(_holders(rows))
    can = rows.where((F.col("op") == "UPDATE_USER") & F.col("alive") & F.col("number_ok"))
    failed = None
    while True:
        updates = can if failed is None else can.join(failed, ["userid", "id"], "left_anti")
        decided = cut_lineage(_decide(rows, _grants(holders, updates)))
        found = decided.where("fails AND number_ok").select("userid", "id")
        same = found.isEmpty() if failed is None else (
            found.join(failed, ["userid", "id"], "left_anti").isEmpty()
            and failed.join(found, ["userid", "id"], "left_anti").isEmpty())
        if same:
            break
        failed = found
    return _answers(decided.where(F.col("op").isin("LOCK_USER", "UPDATE_USER")))


def _answers(d: DataFrame) -> DataFrame:
    is_lock, alive, id_ = F.col("op") == "LOCK_USER", F.col("alive"), F.col("id")
    granted = F.col("grant").isNotNull()
    holder = F.coalesce(F.col("lock.holder").cast("string"), F.lit("None"))
    payload, old = F.coalesce("json", F.lit("null")), F.coalesce("old", F.lit("null"))
    until = F.date_format(F.timestamp_micros("lock.expiry"), S.TIME_TEXT_FORMAT)
    status = (F.when(~alive, S.STATUS_USER_DOESNT_EXIST)
              .when(is_lock & granted, S.STATUS_RECORD_HAS_BEEN_SOFTLOCKED)
              .when(is_lock, S.STATUS_RECORD_ALREADY_SOFTLOCKED)
              .when(~F.col("accepted"), S.STATUS_RECORD_HAS_BEEN_SOFTLOCKED)
              .when(F.col("fails") | ~F.col("number_ok"), S.STATUS_ABORTED)
              .otherwise(S.STATUS_OK))
    text = (F.when(~alive, text_col(S.TEXT_USER_MISSING, userid="userid"))
            .when(is_lock & granted, id_.cast("string"))
            .when(is_lock, text_col(S.TEXT_ALREADY_LOCKED, userid="userid", session=holder))
            .when(~F.col("accepted"), text_col(S.TEXT_CURRENTLY_LOCKED, userid="userid", session=holder, expiry=until))
            .when(F.col("fails"), text_col(S.TEXT_BAD_JSON, userid="userid", old=old, payload=payload))
            .when(~F.col("number_ok"), text_col(S.TEXT_BAD_NUMBER, payload=payload))
            .otherwise(text_col(S.TEXT_USER_UPDATED, userid="userid")))
    session = F.when(~is_lock, F.col("session_id")).when(alive & granted, id_).when(alive, F.col("lock.holder"))
    return d.select(id_.alias("request_id"), "userid", F.timestamp_micros("t").alias("txn_time"), "op",
                    status.cast("int").alias("status"), text.alias("status_text"), session.alias("session_id"))


__all__ = ["lock_decisions", "carry"]
