"""The charging fold as a running stream.

``charge_stream`` groups a streaming request log by users and runs
``transformWithState`` with ``ChargeRowProcessor`` (or its pandas form): a
user's whole state (see ``fold.UserState``) is one value in the RocksDB state
store; every micro-batch's rows of a user are sorted by (time,
request_id) and applied with the same ``step`` function as the batch fold.  A row that is
not later than the last applied request of its user is emitted as ``late``,
with all its columns, and never applied silently.  Initial users and balances are loaded once
through the operator's initial state.

``write_charge_outputs`` is the ``foreachBatch`` sink: decisions, events and
late rows go to parquet folders partitioned by batch id, overwriting only
their own batch on a retry, so a restarted query writes every row exactly
once.

A Python worker pays for every key (an Arrow batch each way, a call to the
store for every value) and for every column of a row.  So the key is a page of
users, not a user: a request travels as one JSON text, the initial rows of a page
as a few texts that are stored as they come and never rewritten, a user gets its
own entry in the page's map state with its first request, and the rows a page puts
out come back as arrays, which Spark turns into rows again.
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tollgate.operators.charge import IN_SCHEMA, OUT_COLS, OUT_SCHEMA, _input_rows, load_state
from tollgate.operators.fold import Output, Request, UserState, step

_LONGS = [f.name for f in IN_SCHEMA.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]
_OUT_LONGS = [f.name for f in OUT_SCHEMA.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: output column of a late row -> the request column that it carries
LATE_FROM = {"request_id": "request_id", "userid": "userid", "t_us": "t_us", "op": "op", "user_txn_id": "txn_id",
             "session_id": "session_id", "spent": "units_used", "approved": "units_wanted", "amount": "amount",
             "json": "json", "message": "delta_op"}


def _as_text(df: DataFrame) -> DataFrame:
    """Long columns as text so that NULLs survive the pandas hand-over exactly."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in _LONGS else F.col(c) for c in df.columns])


def _lists(pdf: pd.DataFrame) -> dict:
    out = {}
    for c in pdf.columns:
        vals = pdf[c].tolist()
        if c in _LONGS:
            out[c] = [None if v is None or v != v else int(v) for v in vals]
        else:
            out[c] = [None if v is None or (isinstance(v, float) and v != v) else v for v in vals]
    return out


class ChargeProcessor(StatefulProcessor):
    """Per-user charging state machine for transformWithStateInPandas."""

    def __init__(self, mode: str = "reference"):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("user_state", "blob STRING")

    def _load(self) -> UserState:
        v = self.state.get()             # one round trip; None when the key has no state yet
        return UserState.from_json(v[0]) if v else UserState()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        st = self._load()
        row = _lists(initialState)
        for i, rec in enumerate(row["rec"]):
            load_state(st, rec, row, i)
        self.state.update((st.to_json(),))

    def handleInputRows(self, key, rows, timerValues):
        uid = int(key[0])
        st = self._load()
        pdf = pd.concat(list(rows), ignore_index=True)
        row = _lists(pdf)
        order = sorted(range(len(pdf)), key=lambda i: (row["t_us"][i], row["request_id"][i]))
        out = Output()
        late = {c: [] for c in LATE_FROM}
        for i in order:
            t, rid = row["t_us"][i], row["request_id"][i]
            if st.last_t is not None and (t, rid) <= (st.last_t, st.last_id):
                for c, source in LATE_FROM.items():
                    late[c].append(uid if source == "userid" else row[source][i])
                continue
            step(st, uid, Request(rid, t, row["op"][i], row["txn_id"][i], row["session_id"][i],
                                  row["units_used"][i], row["units_wanted"][i], row["amount"][i],
                                  row["json"][i], row["delta_op"][i]), out, self.mode)
        self.state.update((st.to_json(),))
        cols = {c: [] for c in OUT_COLS}
        for kind, data in (("decision", out.d), ("event", out.e), ("late", late)):
            n = len(data["request_id"])
            for c in OUT_COLS:
                cols[c].extend([kind] * n if c == "kind" else data.get(c, [None] * n))
        if cols["kind"]:
            res = pd.DataFrame(cols)
            for c in _OUT_LONGS:
                res[c] = res[c].astype("Int32" if c == "status" else "Int64")
            yield res

    def close(self) -> None:
        pass


#: pages of a stream, the keys of its state: they stay for the life of its checkpoint, so take more for more users
PAGES = 4096
#: a page's initial rows are stored in so many parts, by ``userid % PARTS``
PARTS = 4

REQUEST_FIELDS = ["userid", "t_us", "request_id", "op", "txn_id", "session_id", "units_used", "units_wanted", "amount",
                  "json", "delta_op"]
OPENING_FIELDS = ["userid", "rec", "t_us", "txn_id", "session_id", "amount", "json", "lock_session", "lock_expiry_us",
                  "approved", "spent", "purpose"]
OPENING_SCHEMA = T.ArrayType(T.StructType([IN_SCHEMA[c] for c in OPENING_FIELDS]))
OPENING_STATE = ("opening", "part INT", "rows STRING")

#: output rows as arrays of equal length, one per column that a stream fills
PACKED_COLS = [c for c in OUT_COLS if c not in ("lock_session", "lock_expiry_us")]
PACKED_SCHEMA = T.StructType([T.StructField(c, T.ArrayType(OUT_SCHEMA[c].dataType)) for c in PACKED_COLS])
PACKED_ROWS = 4096                       # at most so many of them in one row
_PackedRow = T.Row(*PACKED_COLS)


def page_of(pages: int):
    return F.pmod(F.xxhash64("userid"), F.lit(pages)).cast("int").alias("page")


def packed_requests(requests: DataFrame, pages: int = PAGES) -> DataFrame:
    rows = _input_rows(requests, None, None, None, None)
    return rows.select(page_of(pages), F.to_json(F.struct(*REQUEST_FIELDS)).alias("request"))


def packed_opening(users: DataFrame | None, opening_events: DataFrame | None, usage: DataFrame | None,
                   txns: DataFrame | None, pages: int = PAGES) -> DataFrame:
    """The initial rows, an array in JSON for each page and part."""
    rows = _input_rows(None, users, opening_events, usage, txns, merge_user_balance=True)
    part = F.coalesce(F.pmod("userid", F.lit(PARTS)), F.lit(0)).cast("int").alias("part")
    return (rows.groupBy(page_of(pages), part)
            .agg(F.to_json(F.collect_list(F.struct(*OPENING_FIELDS))).alias("rows")))


def opening_by_user(text: str) -> dict[int, list[dict]]:
    found: dict[int, list[dict]] = {}
    for row in json.loads(text):
        found.setdefault(row.get("userid"), []).append(row)
    return found


class Openings:
    """The initial rows of a page's users, read when the first one is asked for."""

    def __init__(self, state):
        self.state, self.rows = state, None

    def apply(self, st: UserState, uid: int) -> UserState:
        if self.rows is None:
            self.rows = {}
            for _, v in self.state.iterator():
                self.rows.update(opening_by_user(v[0]))
        return load_opening(st, self.rows.get(uid, ()))


def load_opening(st: UserState, rows) -> UserState:
    for row in rows:
        load_state(st, row["rec"], {c: (row.get(c),) for c in OPENING_FIELDS}, 0)
    return st


def requests_by_user(rows, key) -> dict[int, list[tuple]]:
    """(time, request id, the fields by name) of a page's rows, in order of time
    and id for each user.  Rows are packed, or have a column per field; without
    a ``userid`` they are those of the user named by the key."""
    found: dict[int, list[tuple]] = {}
    for row in rows:
        if "request" in row.__fields__:
            r = json.loads(row["request"])
            uid = r.get("userid")
        else:
            r = row.asDict()
            uid = r.get("userid", key[0])
        found.setdefault(int(uid), []).append((r.get("t_us"), r.get("request_id"), r))
    for reqs in found.values():
        reqs.sort(key=lambda r: r[:2])
    return found


def apply_requests(st: UserState, uid: int, reqs: list[tuple], out: Output, mode: str = "reference") -> list[tuple]:
    """Apply a user's requests in order; returns the late ones as output rows."""
    late = []
    for t, rid, r in reqs:
        get = r.get
        if st.last_t is not None and (t, rid) <= (st.last_t, st.last_id):
            late.append(packed_row("late", {c: uid if source == "userid" else get(source) for c, source in LATE_FROM.items()}))
            continue
        step(st, uid, Request(rid, t, get("op"), get("txn_id"), get("session_id"), get("units_used"), get("units_wanted"),
                              get("amount"), get("json"), get("delta_op")), out, mode)
    return late


def packed_row(kind: str, held: dict) -> tuple:
    return tuple(kind if c == "kind" else held.get(c) for c in PACKED_COLS)


def packed_output(out: Output) -> list[tuple]:
    """Decisions and events with a value for each of PACKED_COLS."""
    rest = (None,) * 8
    return ([("decision", uid, rid, t, op, status, text, sess, appr, spent, bal, alloc, None, None, None, None)
             for rid, uid, t, op, status, text, sess, appr, spent, bal, alloc in out.drows]
            + [("event", uid, rid, t, *rest, amount, txn_id, msg, None) for rid, uid, t, amount, txn_id, msg in out.erows])


def packed(rows: list[tuple]):
    for i in range(0, len(rows), PACKED_ROWS):
        yield _PackedRow(*zip(*rows[i:i + PACKED_ROWS]))


def unpacked(df: DataFrame) -> DataFrame:
    """PACKED_SCHEMA -> OUT_SCHEMA, a row per array element."""
    rows = df.select(F.inline(F.arrays_zip(*PACKED_COLS)))
    return rows.select(*[F.col(f.name) if f.name in PACKED_COLS else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in OUT_SCHEMA.fields])


class ChargeRowProcessor(StatefulProcessor):
    """The same state machine for ``transformWithState`` over pages of users: no
    pandas frame per key, values arrive as Python ints/None."""

    def __init__(self, mode: str = "reference"):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "userid BIGINT", "blob STRING")
        self.opening = handle.getMapState(*OPENING_STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.opening.updateValue((initialState["part"],), (initialState["rows"],))

    def handleInputRows(self, key, rows, timerValues):
        out, late, openings = Output(), [], Openings(self.opening)
        for uid, reqs in requests_by_user(rows, key).items():
            v = self.users.getValue((uid,))
            st = UserState.from_json(v[0]) if v else openings.apply(UserState(), uid)
            late += apply_requests(st, uid, reqs, out, self.mode)
            self.users.updateValue((uid,), (st.to_json(),))
        yield from packed(packed_output(out) + late)

    def close(self) -> None:
        pass


def request_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of request-log parquet files (the schema of REQUESTS)."""
    from tollgate import schema as S
    r = spark.readStream.schema(S.REQUESTS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def charge_stream(requests: DataFrame, users: DataFrame | None = None, opening_events: DataFrame | None = None,
                  usage: DataFrame | None = None, txns: DataFrame | None = None,
                  mode: str = "reference", api: str = "rows") -> DataFrame:
    """Streaming replay; returns the wide output stream (kind = decision,
    event or late) in the fold's OUT_SCHEMA.  ``api`` picks the Row-based
    ``transformWithState`` (default) or ``transformWithStateInPandas``."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if api == "rows":
        initial = None
        if any(x is not None for x in (users, opening_events, usage, txns)):
            initial = packed_opening(users, opening_events, usage, txns).groupBy("page")
        return unpacked(packed_requests(requests).groupBy("page").transformWithState(
            statefulProcessor=ChargeRowProcessor(mode), outputStructType=PACKED_SCHEMA, outputMode="Append",
            timeMode="None", initialState=initial))
    reqs = _as_text(_input_rows(requests, None, None, None, None).drop("phase"))
    initial = None
    if any(x is not None for x in (users, opening_events, usage, txns)):
        initial = _as_text(_input_rows(None, users, opening_events, usage, txns).drop("phase")).groupBy("userid")
    return reqs.groupBy("userid").transformWithStateInPandas(
        statefulProcessor=ChargeProcessor(mode), outputStructType=OUT_SCHEMA, outputMode="Append",
        timeMode="None", initialState=initial)


def write_charge_outputs(out_dir: str):
    """foreachBatch sink writing decisions, events and late rows per batch id
    (dynamic partition overwrite: a retried batch replaces only itself)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(int(batch_id)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("kind", "batch_id").parquet(os.path.join(out_dir, "out")))
    return sink


def read_charge_outputs(spark: SparkSession, out_dir: str) -> DataFrame:
    schema = T.StructType([f for f in OUT_SCHEMA.fields if f.name != "kind"]
                          + [T.StructField("kind", T.StringType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(os.path.join(out_dir, "out"))


def decisions_of(out: DataFrame) -> DataFrame:
    return out.filter(F.col("kind") == "decision").select(
        "request_id", "userid", F.timestamp_micros("t_us").alias("txn_time"), "op", "status", "status_text",
        "session_id", "approved", "spent", "balance_after", "allocated_after")


def events_of(out: DataFrame) -> DataFrame:
    return out.filter(F.col("kind") == "event").select(
        "request_id", "userid", "amount", "user_txn_id", "message", F.timestamp_micros("t_us").alias("txn_time"))


def late_of(out: DataFrame) -> DataFrame:
    """The late requests with all their columns, ready to be replayed."""
    return out.filter(F.col("kind") == "late").select(*[
        F.timestamp_micros("t_us").alias("txn_time") if source == "t_us" else F.col(c).alias(source)
        for c, source in LATE_FROM.items()])


def run_available(requests: DataFrame, out_dir: str, checkpoint: str, timeout_s: float | None = None, **kw) -> None:
    """Process every file available now and stop; waits as long as that takes
    unless the caller sets ``timeout_s``."""
    q = (charge_stream(requests, **kw).writeStream.foreachBatch(write_charge_outputs(out_dir))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    try:
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            raise TimeoutError("charge stream did not finish in time")
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


__all__ = ["ChargeProcessor", "ChargeRowProcessor", "charge_stream", "request_stream", "write_charge_outputs",
           "read_charge_outputs", "decisions_of", "events_of", "late_of", "run_available"]
