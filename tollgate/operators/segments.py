"""D1 with a user's log split at idle gaps, so that a hot user is many tasks.

After a gap longer than the reservation TTL (180 minutes, longer than the ledger's
hour) a user's reservations and ledger rows have all expired.  What is left of
the state is the user's existence, balance, JSON and lock.  The JSON and the lock
decide only lock and update requests; the balance never depends on what was
approved.  So a segment, the requests between two gaps, acts on (exists, balance)
as a small function: for each of the four cases of what comes in (user there or
not, balance row there or not) it adds an amount, or starts from nothing after a
delete, and says what goes out.

1. Segments: first and last time per (user, hour) by partial aggregation; gaps
   are found between the hours of a user, which are few.
2. Every segment that another one follows is summed up on its own, in parallel.
3. The summaries of a user, one row per segment, are composed in order: the state
   that comes into each segment.
4. Every segment is replayed on its own from that state, with the same rules as
   ``charge``.  Lock and update requests leave with the balance and reservations
   of their time.
5. These, with the creations and deletions of users, go through the lock rules
   per user: the only step in which a user is still one sequence.

Requires ``mode="reference"``: the strict mode's ledger never expires.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.operators.charge import IN_SCHEMA, OUT_SCHEMA, ChargeResult, _input_rows, _pylists, _Rows, load_state
from tollgate.operators.fold import USAGE_TTL_US, Output, Request, UserState, step
from tollgate.session import cut_lineage

HOUR_US = 3600 * 1_000_000
LOCK_OPS = ("LOCK_USER", "UPDATE_USER")
#: what may come into a segment: is the user there, is there a balance row
CASES = tuple((ex, bal) for ex in (False, True) for bal in (False, True))

SUMMARY = T.StructType([
    T.StructField("userid", T.LongType()), T.StructField("seg", T.LongType()),
    T.StructField("first", T.BooleanType()),           # of the user: the state that goes out, whatever comes in
    T.StructField("exists_in", T.BooleanType()), T.StructField("balance_in", T.BooleanType()),
    T.StructField("exists", T.BooleanType()), T.StructField("balance", T.LongType()),
    T.StructField("adds", T.BooleanType()),            # the balance that comes in is added to ``balance``
])
CARRY = T.StructType([T.StructField("userid", T.LongType()), T.StructField("seg", T.LongType()),
                      T.StructField("exists", T.BooleanType()), T.StructField("balance", T.LongType())])


def segments(rows: DataFrame) -> DataFrame:
    """(userid, hour, seg, segs) for the hours of users with more than one
    segment.  ``rows`` are in IN_SCHEMA."""
    is_req = F.col("phase") == 1
    timed = rows.where(F.col("rec").isin("req", "usage", "txn"))
    hours = timed.groupBy("userid", F.when(is_req, F.floor(F.col("t_us") / F.lit(HOUR_US))).alias("hour")).agg(
        F.min(F.when(is_req, F.col("t_us"))).alias("first_t"), F.max(F.when(is_req, F.col("t_us"))).alias("last_t"),
        F.max(F.when(~is_req, F.col("t_us"))).alias("held_t"))
    user = Window.partitionBy("userid")
    before = user.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    upto = user.orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hours = (hours.withColumn("prev", F.max("last_t").over(before))
             .withColumn("held", F.max("held_t").over(user)))     # reservations and ledger rows from before the log
    idle = (F.col("first_t") - F.col("prev") > USAGE_TTL_US) & F.coalesce(
        F.col("first_t") - F.col("held") > USAGE_TTL_US, F.lit(True))
    hours = (hours.withColumn("seg", F.sum(F.coalesce(idle, F.lit(False)).cast("long")).over(upto))
             .withColumn("segs", F.max("seg").over(user) + 1))
    return hours.where("segs > 1 AND hour IS NOT NULL").select("userid", "hour", "seg", "segs")


def _money(st: UserState, uid: int, row: dict, i: int, out: Output, others: list | None) -> None:
    """One request on a segment's state; what concerns the lock goes to ``others``."""
    op = row["op"][i]
    r = Request(row["request_id"][i], row["t_us"][i], op, row["txn_id"][i], row["session_id"][i], row["units_used"][i],
                row["units_wanted"][i], row["amount"][i], row["json"][i], row["delta_op"][i])
    if op in LOCK_OPS:
        st.expire(r.t, "reference")
        if others is not None:
            others.append(("lock", uid, r.request_id, r.t, op, r.session_id, st.balance, st.alloc, r.json, r.delta_op))
        return
    was = st.exists
    step(st, uid, r, out, "reference")
    if others is not None and (st.exists != was or op == "DELETE_USER"):
        others.append(("created" if st.exists else "deleted", uid, r.request_id, r.t, op, None, None, None, r.json, None))


class _Sums(Output):
    """Keeps nothing but the balance."""

    def decision(self, *args, **kw):
        pass

    def event(self, r, uid, st, amount, txn_id, message):
        st.balance = (st.balance or 0) + amount


def _case(ex: bool, bal: bool) -> UserState:
    st = UserState()
    st.exists, st.balance = ex, 0 if bal else None
    return st


def summarise(batches):
    """mapInArrow body: rows sorted by (userid, seg, phase, t_us, request_id);
    the summaries of each segment."""
    key, states, kept = None, {}, {}
    rows: list[tuple] = []
    sink = _Sums()

    def close():
        if key is None:
            return
        for case, st in states.items():
            first = case is None
            ex, bal = case or (None, None)
            rows.append((*key, first, ex, bal, st.exists, st.balance, not first and bal and kept[case]))

    for batch in batches:
        row = _pylists(batch)
        for i in range(batch.num_rows):
            k = (row["userid"][i], row["seg"][i])
            if k != key:
                close()
                key = k
                states = {c: _case(*c) for c in CASES} if k[1] else {None: UserState()}
                kept = dict.fromkeys(states, True)
            for case, st in states.items():
                if row["rec"][i] != "req":
                    load_state(st, row["rec"][i], row, i)
                    continue
                _money(st, key[0], row, i, sink, None)
                if row["op"][i] == "DELETE_USER":
                    kept[case] = False
        if len(rows) > 10_000:
            yield _batch(rows, SUMMARY)
            rows = []
    close()
    yield _batch(rows, SUMMARY)


def carry(batches):
    """mapInArrow body: summaries sorted by (userid, seg); the state that comes
    into the segment behind each."""
    rows: list[tuple] = []
    uid, ex, bal = None, False, None
    for batch in batches:
        for s in batch.to_pylist():
            if s["userid"] != uid:
                uid, ex, bal, at = s["userid"], False, None, None
            if s["seg"] != at:
                at, come = s["seg"], (ex, bal)
            if not s["first"] and (s["exists_in"], s["balance_in"]) != (come[0], come[1] is not None):
                continue
            ex, bal = s["exists"], s["balance"]
            if s["adds"]:
                bal += come[1]
            rows.append((uid, s["seg"] + 1, ex, bal))
        yield _batch(rows, CARRY)
        rows = []


def replay(batches):
    """mapInArrow body of the last pass: segments with the state that comes in;
    decisions and events, the final state of a user's last segment, and the rows
    for the lock rules (kinds lock, created, deleted)."""
    key, st, last = None, None, True
    names = ("kind", "userid", "request_id", "t_us", "op", "session_id", "balance_after", "allocated_after", "json", "message")
    for batch in batches:
        row = _pylists(batch)
        rows, out, others = _Rows(), Output(), []
        for i in range(batch.num_rows):
            k = (row["userid"][i], row["seg"][i])
            if k != key:
                if key is not None and last:
                    rows.add_final(key[0], _without_user(st))
                key, st, last = k, UserState(), True
            rec = row["rec"][i]
            if rec == "carry":
                st.exists, st.balance = row["units_used"][i] == 1, row["amount"][i]
            elif rec != "req":
                load_state(st, rec, row, i)
            else:
                last = row["last"][i]
                _money(st, key[0], row, i, out, others)
        rows.add_output(out)
        for kind in ("lock", "created", "deleted"):
            some = [x for x in others if x[0] == kind]
            rows.add(kind, {n: [x[j] for x in some] for j, n in enumerate(names) if j}, len(some))
        yield from rows.batches()
    if key is not None and last:
        rows = _Rows()
        rows.add_final(key[0], _without_user(st))
        yield from rows.batches()


def _without_user(st: UserState) -> UserState:
    """The user row is the lock rules' to give."""
    st.exists = False
    return st


def locks(batches):
    """mapInArrow body: per user, initial rows and rows for the lock rules in
    order; the decisions of lock and update requests and the final user rows."""
    uid, st = None, None
    for batch in batches:
        row = _pylists(batch)
        rows, out = _Rows(), Output()
        for i in range(batch.num_rows):
            if row["userid"][i] != uid:
                if uid is not None and st.exists:
                    rows.add_final(uid, st)
                uid, st = row["userid"][i], UserState()
            kind = row["kind"][i]
            if kind == "user":
                st.exists, st.json, st.last_seen = True, row["json"][i], row["t_us"][i]
                st.lock_session, st.lock_expiry = row["lock_session"][i], row["lock_expiry_us"][i]
            elif kind == "deleted":
                st.clear()
            elif kind == "created":
                st.exists, st.json, st.last_seen = True, row["json"][i], row["t_us"][i]
                st.lock_session = st.lock_expiry = None
            else:
                st.balance, st.alloc = row["balance_after"][i], row["allocated_after"][i]
                step(st, uid, Request(row["request_id"][i], row["t_us"][i], row["op"][i], session_id=row["session_id"][i],
                                      json=row["json"][i], delta_op=row["message"][i]), out)
                st.balance, st.alloc = None, 0
        rows.add_output(out)
        yield from rows.batches()
    if uid is not None and st.exists:
        rows = _Rows()
        rows.add_final(uid, st)
        yield from rows.batches()


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)


def charge_by_segments(requests: DataFrame, users: DataFrame | None = None, opening_events: DataFrame | None = None,
                       usage: DataFrame | None = None, txns: DataFrame | None = None) -> ChargeResult:
    """The result of ``charge`` in reference mode, with every user's log split
    at its idle gaps.  The segmented input and the money side of the replay are
    stored once each (reliable checkpoints in the shared folder), as several
    steps read them."""
    inp = _input_rows(requests, users, opening_events, usage, txns)
    hours = segments(inp)
    is_req = F.col("phase") == 1
    rows = (inp.withColumn("hour", F.when(is_req, F.floor(F.col("t_us") / F.lit(HOUR_US))))
            .join(hours, ["userid", "hour"], "left")
            .select(*[f.name for f in IN_SCHEMA.fields], F.coalesce("seg", F.lit(0)).alias("seg"),
                    F.coalesce(F.col("seg") + 1 == F.col("segs"), F.lit(True)).alias("last"),
                    F.col("segs").isNotNull().alias("split")))
    rows = cut_lineage(rows)
    order = ("userid", "seg", "phase", "t_us", "request_id")

    # a split user's initial rows belong to its first segment
    followed = rows.where((F.col("split") & ~F.col("last")) | ~is_req)
    many = rows.where("split").select("userid").distinct()
    followed = followed.join(many, "userid", "left_semi").drop("split", "last")
    sums = followed.repartition("userid", "seg").sortWithinPartitions(*order).mapInArrow(summarise, SUMMARY)
    into = sums.repartition("userid").sortWithinPartitions("userid", "seg").mapInArrow(carry, CARRY)
    coming = {"userid": F.col("userid"), "phase": F.lit(0), "rec": F.lit("carry"), "amount": F.col("balance"),
              "units_used": F.col("exists").cast("long"), "request_id": F.lit(0).cast("long"), "t_us": F.lit(0).cast("long")}
    into = into.select(*[coming.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in IN_SCHEMA.fields], "seg",
                       F.lit(True).alias("last"))
    money = (rows.drop("split").unionByName(into).repartition("userid", "seg").sortWithinPartitions(*order)
             .mapInArrow(replay, OUT_SCHEMA))
    money = cut_lineage(money)

    lock_kinds = F.col("kind").isin("lock", "created", "deleted")
    first = inp.where("rec = 'user'")
    first = first.select(*[F.lit("user").alias("kind") if f.name == "kind"
                           else (F.col(f.name) if f.name in first.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in OUT_SCHEMA.fields])
    locked = (money.where(lock_kinds).withColumn("phase", F.lit(1)).unionByName(first.withColumn("phase", F.lit(0)))
              .repartition("userid").sortWithinPartitions("userid", "phase", "t_us", "request_id").drop("phase")
              .mapInArrow(locks, OUT_SCHEMA))
    return ChargeResult(money.where(~lock_kinds).unionByName(locked))


__all__ = ["charge_by_segments", "segments"]
