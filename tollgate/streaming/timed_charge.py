"""D9 with keyed map state and event-time timers.

``charge_stream_timed`` keeps the scalars of users in a map state, the reservations
in one by user and session and the ledger in one by user and txn id.  The keys are
the pages of users of ``charge_stream``: a micro-batch reads the entries of the
pages it touches, applies the rules of the fold and writes back only the entries
that changed, so what it writes follows the rows it touches.

Every page with reservations has one timer, for the moment when the oldest one
passes its 180 minutes (R1).  When the watermark gets there what is due is released, though the user may stay idle for ever; releases are rows of kind
``expired``, whether a timer or the user's own next request found them.  The
watermark is observed on the requests, but no row is dropped for being behind
it: rows not later than what was applied or released for their user go to the
``late`` output with all their columns, as in ``charge_stream``.

``read_state`` gives users, reservations, ledger and balances from a checkpoint,
without touching the running query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tollgate.operators.charge import OUT_SCHEMA, ChargeResult
from tollgate.operators.fold import USAGE_TTL_US, Output, UserState
from tollgate.streaming.charge_stream import (OPENING_SCHEMA, OPENING_STATE, PACKED_SCHEMA, PAGES, ROCKSDB, Openings,
                                              apply_requests, load_opening, opening_by_user, packed, packed_opening,
                                              packed_output, packed_requests, packed_row, requests_by_user, unpacked,
                                              write_charge_outputs)

CORE = ("exists BOOLEAN, json STRING, last_seen BIGINT, lock_session BIGINT, lock_expiry BIGINT, balance BIGINT, "
        "last_t BIGINT, last_id BIGINT")
USAGE = "amount BIGINT, lastdate BIGINT"
LEDGER = "t BIGINT, session BIGINT, approved BIGINT, spent BIGINT, purpose STRING"
#: request id of a release in the order of a user's rows: behind all requests of its time
LAST_ID = (1 << 63) - 1


class _State(UserState):
    """A user's state that notes which reservations the TTL took."""

    __slots__ = ("released",)

    def __init__(self):
        super().__init__()
        self.released: list[tuple] = []      # session, amount, lastdate

    def expire(self, now, mode):
        cutoff = now - USAGE_TTL_US
        if self.usage_heap and self.usage_heap[0][0] < cutoff:
            self.released += [(s, a, d) for s, (a, d) in self.usage.items() if d < cutoff]
        super().expire(now, mode)


def timer_of(lastdate: int) -> int:
    """The first millisecond behind a reservation's TTL."""
    return (lastdate + USAGE_TTL_US) // 1000 + 1


class _Page:
    """The entries of a page's users as they are stored."""

    def __init__(self, core, usage, ledger):
        self.core = {k[0]: tuple(v) for k, v in core.iterator()}
        self.usage: dict[int, dict] = {}
        self.ledger: dict[int, dict] = {}
        for state, held in ((usage, self.usage), (ledger, self.ledger)):
            for (uid, name), v in state.iterator():
                held.setdefault(uid, {})[name] = tuple(v)

    def user(self, uid: int) -> _State:
        st = _State()
        (st.exists, st.json, st.last_seen, st.lock_session, st.lock_expiry, st.balance, st.last_t, st.last_id) = self.core[uid]
        for session, (amount, lastdate) in self.usage.get(uid, {}).items():
            st.set_usage(session, amount, lastdate)
        st.ledger.rows.update(self.ledger.get(uid, {}))
        st.ledger.order.extend(sorted((v[0], k) for k, v in st.ledger.rows.items()))
        return st

    def due(self) -> int | None:
        return min((timer_of(d) for held in self.usage.values() for _, d in held.values()), default=None)


class TimedChargeProcessor(StatefulProcessor):
    """The charging state machine over map state, with timers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "due BIGINT")
        self.core = handle.getMapState("core", "userid BIGINT", CORE)
        self.usage = handle.getMapState("usage", "userid BIGINT, session BIGINT", USAGE)
        self.ledger = handle.getMapState("ledger", "userid BIGINT, txn_id STRING", LEDGER)
        self.opening = handle.getMapState(*OPENING_STATE)

    # -------------------------------------------------------------- state ---
    def _page(self) -> _Page:
        return _Page(self.core, self.usage, self.ledger)

    def _store(self, page: _Page, uid: int, st: _State) -> None:
        """Writes what differs from the user's entries in ``page``."""
        for state, held, new in ((self.usage, page.usage, st.usage), (self.ledger, page.ledger, st.ledger.rows)):
            old = held.get(uid, {})
            for k in old.keys() - new.keys():
                state.removeKey((uid, k))
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue((uid, k), v)
            held[uid] = new
        core = (st.exists, st.json, st.last_seen, st.lock_session, st.lock_expiry, st.balance, st.last_t, st.last_id)
        if page.core.get(uid) != core:
            self.core.updateValue((uid,), core)
            page.core[uid] = core

    def _set_timer(self, due: int | None, fired: int | None = None) -> None:
        """Moves the page's timer."""
        held = self.timer.get()
        timer = held[0] if held else None
        if due != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
            self.timer.update((due,))

    # ------------------------------------------------------------ handlers ---
    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Initial rows wait for their user's first request; those of users with
        reservations, which have to be released in time, are applied."""
        text = initialState["rows"]
        self.opening.updateValue((initialState["part"],), (text,))
        reserved = [(uid, rows) for uid, rows in opening_by_user(text).items() if any(r["rec"] == "usage" for r in rows)]
        if reserved:
            page = self._page()
            for uid, rows in reserved:
                self._store(page, uid, load_opening(_State(), rows))
            self._set_timer(page.due())

    def handleInputRows(self, key, rows, timerValues):
        page, openings, out, more = self._page(), Openings(self.opening), Output(), []
        for uid, reqs in requests_by_user(rows, key).items():
            st = page.user(uid) if uid in page.core else openings.apply(_State(), uid)
            more += apply_requests(st, uid, reqs, out)
            self._store(page, uid, st)
            more += _releases(uid, st)
        self._set_timer(page.due())
        yield from packed(packed_output(out) + more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        page, fired, more = self._page(), expiredTimerInfo.getExpiryTimeInMs(), []
        mark = max(fired, timerValues.getCurrentWatermarkInMs())
        for uid in [u for u, held in page.usage.items() if any(timer_of(d) <= mark for _, d in held.values())]:
            st = page.user(uid)
            st.expire(mark * 1000, "strict")     # reservations only: ledger rows go with the user's requests
            last = max(d for _, _, d in st.released) + USAGE_TTL_US
            if st.last_t is None or last >= st.last_t:
                st.last_t, st.last_id = last, LAST_ID
            self._store(page, uid, st)
            more += _releases(uid, st)
        self._set_timer(page.due(), fired)
        yield from packed(more)

    def close(self) -> None:
        pass


def _releases(uid: int, st: _State) -> list[tuple]:
    return [packed_row("expired", {"userid": uid, "session_id": s, "amount": a, "t_us": d + USAGE_TTL_US})
            for s, a, d in st.released]


def charge_stream_timed(requests: DataFrame, users: DataFrame | None = None, opening_events: DataFrame | None = None,
                        usage: DataFrame | None = None, txns: DataFrame | None = None,
                        watermark: str = "10 minutes", pages: int = PAGES) -> DataFrame:
    """The streaming replay (reference mode) with map state and timers; rows of
    kind decision, event, late and expired in the fold's OUT_SCHEMA."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the watermark is taken from txn_time; the rows go on without that column, so none is dropped by it
    reqs = packed_requests(requests.withWatermark("txn_time", watermark), pages)
    initial = None
    if any(x is not None for x in (users, opening_events, usage, txns)):
        initial = packed_opening(users, opening_events, usage, txns, pages).groupBy("page")
    return unpacked(reqs.groupBy("page").transformWithState(
        statefulProcessor=TimedChargeProcessor(), outputStructType=PACKED_SCHEMA, outputMode="Append",
        timeMode="EventTime", initialState=initial))


def run_timed(requests: DataFrame, out_dir: str, checkpoint: str, timeout_s: float | None = None, **kw) -> None:
    """Process all that is available now and stop."""
    q = (charge_stream_timed(requests, **kw).writeStream.foreachBatch(write_charge_outputs(out_dir))
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


def releases_of(out: DataFrame) -> DataFrame:
    """Reservations that passed their TTL: userid, session_id, amount, released_at."""
    return out.filter(F.col("kind") == "expired").select("userid", "session_id", "amount",
                                                         F.timestamp_micros("t_us").alias("released_at"))


def read_state(spark: SparkSession, checkpoint: str) -> ChargeResult:
    """Users, reservations, ledger and balances as they stand in the checkpoint
    of a (running or stopped) query; expired entries that nothing has touched
    since are still there."""
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    def shaped(df: DataFrame, kind: str, **cols) -> DataFrame:
        given = {"kind": F.lit(kind), **cols}
        return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OUT_SCHEMA.fields])

    core, usage, ledger = state("core"), state("usage"), state("ledger")
    k, v = F.col("user_map_key"), F.col("user_map_value")
    users = shaped(core.where(v["exists"]), "user", userid=k["userid"], json=v["json"], t_us=v["last_seen"],
                   lock_session=v["lock_session"], lock_expiry_us=v["lock_expiry"])
    balances = shaped(core.where(v["balance"].isNotNull()), "balance", userid=k["userid"], amount=v["balance"])
    reserved = shaped(usage, "usage", userid=k["userid"], session_id=k["session"], amount=v["amount"], t_us=v["lastdate"])
    txns = shaped(ledger, "txn", userid=k["userid"], user_txn_id=k["txn_id"], t_us=v["t"], session_id=v["session"],
                  approved=v["approved"], spent=v["spent"], message=v["purpose"])
    # users without a request yet stand as they opened
    opened = (state("opening").select(F.inline(F.from_json(v["rows"], OPENING_SCHEMA)))
              .join(core.select(k["userid"].alias("userid")), "userid", "left_anti"))
    rec, own = F.col("rec"), {c: F.col(c) for c in ("userid", "t_us", "json", "lock_session", "lock_expiry_us")}
    opened_users = shaped(opened.where(rec.isin("user", "user_balance")), "user", **own)
    opened_balances = shaped(opened.where(rec.isin("balance", "user_balance") & F.col("amount").isNotNull()), "balance",
                             userid=own["userid"], amount=F.col("amount"))
    opened_txns = shaped(opened.where(rec == "txn"), "txn", userid=own["userid"], user_txn_id=F.col("txn_id"),
                         message=F.col("purpose"), **{c: F.col(c) for c in ("t_us", "session_id", "approved", "spent")})
    raw = users
    for part in (balances, reserved, txns, opened_users, opened_balances, opened_txns):
        raw = raw.unionByName(part)
    return ChargeResult(raw)


__all__ = ["TimedChargeProcessor", "charge_stream_timed", "run_timed", "releases_of", "read_state"]
