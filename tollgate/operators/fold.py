"""The per-user charging rules as a pure-Python step function.

``UserState`` holds one user's state; ``step`` applies one request to it and
appends decision and financial-event rows to an ``Output``.  The same code
runs inside the batch fold (``charge.py``) and the streaming processor
(``streaming/charge_stream.py``), so both give the same answers.

in ``mode="reference"``; ``mode="strict"`` switches off the quirks Q1
(decide after the spend), Q2 (no money for a duplicate credit) and Q10
(infinite duplicate horizon: no pruning, no ledger TTL).
"""

from __future__ import annotations

import datetime as _dt
import heapq
import json as _json
import re
from collections import deque

from tollgate import schema as S

MINUTE_US = 60 * 1_000_000
USAGE_TTL_US = S.USAGE_TTL_MINUTES * MINUTE_US
TXN_TTL_US = S.TXN_TTL_SECONDS * 1_000_000
PRUNE_TWO_AGE_US = S.PRUNE_TWO_AGE_SECONDS * 1_000_000
PRUNE_OLDEST_AGE_US = S.PRUNE_OLDEST_AGE_SECONDS * 1_000_000
LOCK_TIMEOUT_US = S.LOCK_TIMEOUT_MS * 1000

_EPOCH = _dt.datetime(1970, 1, 1)
_LONG = re.compile(r"[+-]?[0-9]+\Z")
_I64_MIN, _I64_MAX = -(1 << 63), (1 << 63) - 1


def fmt_ts(us: int) -> str:
    """Timestamp text embedded in status strings: yyyy-MM-dd HH:mm:ss.ffffff (UTC)."""
    return (_EPOCH + _dt.timedelta(microseconds=us)).strftime("%Y-%m-%d %H:%M:%S.%f")


def parse_long(text):
    """Long.parseLong: optional sign and digits, within range; None otherwise."""
    if text is None or not _LONG.match(text):
        return None
    v = int(text)
    return v if _I64_MIN <= v <= _I64_MAX else None


def _java_str(v) -> str:
    """A value as Java string concatenation prints it (null for None)."""
    return "null" if v is None else str(v)


def _gson_str(s: str) -> str:
    out = _json.dumps(s, ensure_ascii=False)
    for ch, esc in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("=", "\\u003d"), ("'", "\\u0027")):
        out = out.replace(ch, esc)
    return out


def apply_loyalty_delta(old_json, payload, uid=None):
    """NEW_LOYALTY_NUMBER: returns (new_json, None) or (None, error_text)."""
    try:
        obj = _json.loads(old_json) if old_json is not None else None
    except ValueError:
        obj = "bad"
    if not isinstance(obj, dict):
        return None, S.TEXT_BAD_JSON.format(userid=uid, old=_java_str(old_json), payload=_java_str(payload))
    number = parse_long(payload)
    if number is None:
        return None, S.TEXT_BAD_NUMBER.format(payload=_java_str(payload))
    parts = []
    for name in S.JSON_FIELDS[:2]:
        v = obj.get(name)
        if v is not None:
            parts.append(f'"{name}":{_gson_str(str(v))}')
    parts.append(f'"{S.JSON_FIELDS[2]}":{number}')
    return "{" + ",".join(parts) + "}", None


class Ledger:
    """The user's recent transactions: dict by txn id plus a deque of
    (time, txn id) keys in ascending order.  Requests arrive in time order, so
    inserts go to the back and every removal (prune, TTL) is at the front."""

    __slots__ = ("rows", "order")

    def __init__(self):
        self.rows: dict[str, tuple] = {}     # txn_id -> (time, sessionid, approved, spent, purpose)
        self.order: deque = deque()          # (time, txn_id), ascending

    def get(self, txn_id):
        return self.rows.get(txn_id)

    def insert(self, txn_id, time, sessionid, approved, spent, purpose):
        if txn_id in self.rows:
            self.remove(txn_id)
        self.rows[txn_id] = (time, sessionid, approved, spent, purpose)
        key = (time, txn_id)
        if not self.order or self.order[-1] <= key:
            self.order.append(key)
        else:
            i = len(self.order)
            while i > 0 and self.order[i - 1] > key:
                i -= 1
            self.order.insert(i, key)

    def _clean_front(self):
        while self.order and self.order[0][1] not in self.rows:
            self.order.popleft()
        while self.order and self.rows[self.order[0][1]][0] != self.order[0][0]:
            self.order.popleft()
            while self.order and self.order[0][1] not in self.rows:
                self.order.popleft()

    def oldest(self):
        self._clean_front()
        return self.order[0] if self.order else None

    def remove(self, txn_id):
        self.rows.pop(txn_id, None)          # its key in ``order`` is dropped lazily

    def pop_older(self, cutoff, limit=None):
        """Remove up to ``limit`` oldest rows with time < cutoff (strict)."""
        n = 0
        while limit is None or n < limit:
            first = self.oldest()
            if first is None or first[0] >= cutoff:
                break
            self.order.popleft()
            del self.rows[first[1]]
            n += 1
        return n

    def clear(self):
        self.rows.clear()
        self.order.clear()

    def items_sorted(self):
        return sorted(((v[0], k, v) for k, v in self.rows.items()))


class UserState:
    __slots__ = ("exists", "json", "last_seen", "lock_session", "lock_expiry", "balance",
                 "usage", "alloc", "usage_heap", "ledger", "last_t", "last_id")

    def __init__(self):
        self.exists = False
        self.json = None
        self.last_seen = None
        self.lock_session = None
        self.lock_expiry = None
        self.balance = None                  # None = no balance row
        self.usage: dict = {}                # session -> (amount, lastdate)
        self.alloc = 0                       # sum of usage amounts
        self.usage_heap: list = []           # (lastdate, session), lazily invalidated
        self.ledger = Ledger()
        self.last_t = None                   # time of the last applied request
        self.last_id = None                  # its request id

    # -- reservations ------------------------------------------------------
    def set_usage(self, session, amount, lastdate):
        old = self.usage.get(session)
        if old is not None:
            self.alloc -= old[0]
        self.usage[session] = (amount, lastdate)
        self.alloc += amount
        heapq.heappush(self.usage_heap, (lastdate, session))
        if len(self.usage_heap) > 2 * len(self.usage) + 16:
            self.usage_heap = [(d, s) for s, (_, d) in self.usage.items()]
            heapq.heapify(self.usage_heap)

    def drop_usage(self, session):
        old = self.usage.pop(session, None)
        if old is not None:
            self.alloc -= old[0]
        return old

    def expire(self, now, mode):
        cutoff = now - USAGE_TTL_US
        h = self.usage_heap
        while h and h[0][0] < cutoff:
            d, s = heapq.heappop(h)
            cur = self.usage.get(s)
            if cur is not None and cur[1] == d:
                self.drop_usage(s)
        if mode != "strict":
            self.ledger.pop_older(now - TXN_TTL_US)

    def clear(self):
        self.exists = False
        self.json = self.last_seen = self.lock_session = self.lock_expiry = None
        self.balance = None
        self.usage.clear()
        self.usage_heap = []
        self.alloc = 0
        self.ledger.clear()

    # -- serialisation for the streaming state store ------------------------
    def to_json(self) -> str:
        return _json.dumps([self.exists, self.json, self.last_seen, self.lock_session, self.lock_expiry,
                            self.balance, [[s, a, d] for s, (a, d) in self.usage.items()],
                            [[k, *v] for _, k, v in self.ledger.items_sorted()], self.last_t, self.last_id])

    @classmethod
    def from_json(cls, text: str) -> "UserState":
        (ex, js, seen, ls, le, bal, usage, txns, last_t, last_id) = _json.loads(text)
        st = cls()
        st.exists, st.json, st.last_seen, st.lock_session, st.lock_expiry, st.balance = ex, js, seen, ls, le, bal
        for s, a, d in usage:
            st.set_usage(s, a, d)
        for k, t, sess, appr, spent, purpose in txns:
            st.ledger.insert(k, t, sess, appr, spent, purpose)
        st.last_t, st.last_id = last_t, last_id
        return st


class Output:
    """Decision and financial-event rows of the fold (one tuple per row;
    ``d`` and ``e`` give them as column lists)."""

    DECISION_COLS = ("request_id", "userid", "t_us", "op", "status", "status_text", "session_id",
                     "approved", "spent", "balance_after", "allocated_after")
    EVENT_COLS = ("request_id", "userid", "t_us", "amount", "user_txn_id", "message")

    __slots__ = ("drows", "erows")

    def __init__(self):
        self.drows: list = []
        self.erows: list = []

    def decision(self, r, uid, st, status, text, session=None, approved=None, spent=None):
        self.drows.append((r.request_id, uid, r.t, r.op, status, text, session, approved, spent,
                           st.balance, st.alloc))

    def event(self, r, uid, st, amount, txn_id, message):
        self.erows.append((r.request_id, uid, r.t, amount, txn_id, message))
        st.balance = (st.balance or 0) + amount

    @staticmethod
    def _columns(names, rows):
        if not rows:
            return {c: [] for c in names}
        return {c: list(v) for c, v in zip(names, zip(*rows))}

    @property
    def d(self) -> dict:
        return self._columns(self.DECISION_COLS, self.drows)

    @property
    def e(self) -> dict:
        return self._columns(self.EVENT_COLS, self.erows)


class Request:
    __slots__ = ("request_id", "t", "op", "txn_id", "session_id", "units_used", "units_wanted",
                 "amount", "json", "delta_op")

    def __init__(self, request_id, t, op, txn_id=None, session_id=None, units_used=None,
                 units_wanted=None, amount=None, json=None, delta_op=None):
        self.request_id, self.t, self.op, self.txn_id = request_id, t, op, txn_id
        self.session_id, self.units_used, self.units_wanted = session_id, units_used, units_wanted
        self.amount, self.json, self.delta_op = amount, json, delta_op


def step(st: UserState, uid: int, r: Request, out: Output, mode: str = "reference") -> None:
    """Apply one request of user ``uid`` at time ``r.t``."""
    now = r.t
    if st.usage_heap or st.ledger.rows:
        st.expire(now, mode)
    st.last_t, st.last_id = now, r.request_id
    handler = _HANDLERS.get(r.op)
    if handler is None:
        out.decision(r, uid, st, S.STATUS_ABORTED, S.TEXT_UNKNOWN_OP.format(op=r.op))
    else:
        handler(st, uid, r, out, mode)


def _delete_user(st, uid, r, out, mode):
    st.clear()
    out.decision(r, uid, st, S.STATUS_OK, None)


def _already(dup) -> str:
    return S.TEXT_ALREADY_HAPPENED.format(time=fmt_ts(dup[0]))


def _report_usage(st, uid, r, out, mode):
    now = r.t
    # no session, or the marker that callers send for none, opens one named by the request
    session = r.request_id if r.session_id is None or r.session_id == _I64_MIN else r.session_id
    if not st.exists:
        out.decision(r, uid, st, S.STATUS_USER_DOESNT_EXIST, S.TEXT_USER_MISSING.format(userid=uid), session)
        return
    if r.txn_id is None:
        # the ledger's txn id is NOT NULL: the insert fails and the call aborts
        out.decision(r, uid, st, S.STATUS_ABORTED, S.TEXT_NO_TXN_ID.format(userid=uid), session)
        return
    dup = st.ledger.get(r.txn_id)
    wanted = r.units_wanted or 0
    if dup is None and wanted != 0 and st.balance is None:
        # the balance read finds no row: the call aborts and nothing it did stays
        out.decision(r, uid, st, S.STATUS_ABORTED, S.TEXT_NO_BALANCE.format(userid=uid), session)
        return
    if mode != "strict":
        st.ledger.pop_older(now - PRUNE_TWO_AGE_US, limit=2)
    if dup is not None:
        out.decision(r, uid, st, S.STATUS_TXN_ALREADY_HAPPENED, _already(dup), session)
        return
    spent = -(r.units_used or 0)
    text = S.TEXT_SPENT.format(spent=spent)
    st.drop_usage(session)
    bal, alloc = st.balance, st.alloc                  # read before the spend is recorded (Q1)
    if spent != 0:
        out.event(r, uid, st, spent, r.txn_id, text)
    if wanted == 0:
        st.ledger.insert(r.txn_id, now, session, 0, spent, text)
        out.decision(r, uid, st, S.STATUS_OK, None, session, 0, spent)
        return
    avail = (bal + spent if mode == "strict" else bal) - alloc
    if avail < 0:
        approved, status = 0, S.STATUS_NO_MONEY
        text += S.TEXT_NEGATIVE_BALANCE.format(avail=avail)
    elif wanted > avail:
        approved, status = avail, S.STATUS_SOME_UNITS_ALLOCATED
        text += S.TEXT_SOME_ALLOCATED.format(avail=avail, wanted=wanted)
    else:
        approved, status = wanted, S.STATUS_ALL_UNITS_ALLOCATED
        text += S.TEXT_ALL_ALLOCATED.format(wanted=wanted)
    st.set_usage(session, approved, now)
    st.ledger.insert(r.txn_id, now, session, approved, spent, text)
    out.decision(r, uid, st, status, text, session, approved, spent)


def _add_credit(st, uid, r, out, mode):
    now = r.t
    if not st.exists:
        out.decision(r, uid, st, S.STATUS_USER_DOESNT_EXIST, S.TEXT_USER_ID_MISSING.format(userid=uid))
        return
    if r.txn_id is None:
        out.decision(r, uid, st, S.STATUS_ABORTED, S.TEXT_NO_TXN_ID.format(userid=uid))
        return
    amount = r.amount or 0
    dup = st.ledger.get(r.txn_id)
    oldest = st.ledger.oldest() if mode != "strict" else None   # read before the insert
    if dup is not None:
        if mode != "strict":
            out.event(r, uid, st, amount, r.txn_id, S.MSG_CREDIT_ALREADY_ADDED)
        out.decision(r, uid, st, S.STATUS_TXN_ALREADY_HAPPENED, _already(dup))
    else:
        st.ledger.insert(r.txn_id, now, None, 0, amount, S.PURPOSE_ADD_CREDIT)
        out.event(r, uid, st, amount, r.txn_id, S.MSG_ADDED.format(amount=amount))
        out.decision(r, uid, st, S.STATUS_CREDIT_ADDED, S.TEXT_CREDIT_ADDED.format(amount=amount, txn_id=r.txn_id), None, 0, amount)
    if oldest is not None and oldest[0] < now - PRUNE_OLDEST_AGE_US:
        st.ledger.remove(oldest[1])
        # decision rows were appended before the delete; the ledger is state only


def _upsert_user(st, uid, r, out, mode=None):
    now = r.t
    if r.txn_id is None:
        out.decision(r, uid, st, S.STATUS_ABORTED, S.TEXT_NO_TXN_ID.format(userid=uid))
        return
    dup = st.ledger.get(r.txn_id)
    if dup is not None:
        out.decision(r, uid, st, S.STATUS_TXN_ALREADY_HAPPENED, _already(dup))
        return
    amount = r.amount or 0
    st.ledger.insert(r.txn_id, now, None, 0, amount, S.PURPOSE_UPSERT_USER)
    if not st.exists:
        st.exists, st.json, st.last_seen = True, r.json, now
        st.lock_session = st.lock_expiry = None
        out.event(r, uid, st, amount, r.txn_id, S.MSG_USER_CREATED)
        out.decision(r, uid, st, S.STATUS_OK, S.TEXT_USER_CREATED.format(userid=uid, amount=amount), None, 0, amount)
    else:
        out.event(r, uid, st, amount, r.txn_id, S.MSG_USER_UPSERTED)
        out.decision(r, uid, st, S.STATUS_OK,
                     S.TEXT_USER_UPSERTED.format(userid=uid, amount=amount), None, 0, amount)


def _lock_user(st, uid, r, out, mode=None):
    now = r.t
    if not st.exists:
        out.decision(r, uid, st, S.STATUS_USER_DOESNT_EXIST, S.TEXT_USER_MISSING.format(userid=uid))
        return
    if st.lock_expiry is not None and st.lock_expiry > now:
        out.decision(r, uid, st, S.STATUS_RECORD_ALREADY_SOFTLOCKED,
                     S.TEXT_ALREADY_LOCKED.format(userid=uid, session=st.lock_session), st.lock_session)
        return
    st.lock_session = r.request_id
    st.lock_expiry = now + LOCK_TIMEOUT_US
    out.decision(r, uid, st, S.STATUS_RECORD_HAS_BEEN_SOFTLOCKED, str(r.request_id), r.request_id)


def _update_locked_user(st, uid, r, out, mode=None):
    if not st.exists:
        out.decision(r, uid, st, S.STATUS_USER_DOESNT_EXIST, S.TEXT_USER_MISSING.format(userid=uid), r.session_id)
        return
    if st.lock_expiry is None or st.lock_session == r.session_id:
        new_json = r.json
        if r.delta_op == S.NEW_LOYALTY_NUMBER:
            new_json, err = apply_loyalty_delta(st.json, r.json, uid)
            if err is not None:
                out.decision(r, uid, st, S.STATUS_ABORTED, err, r.session_id)
                return
        st.json = new_json
        st.lock_session = st.lock_expiry = None
        out.decision(r, uid, st, S.STATUS_OK, S.TEXT_USER_UPDATED.format(userid=uid), r.session_id)
    else:
        out.decision(r, uid, st, S.STATUS_RECORD_HAS_BEEN_SOFTLOCKED,
                     S.TEXT_CURRENTLY_LOCKED.format(userid=uid, session=st.lock_session, expiry=fmt_ts(st.lock_expiry)),
                     r.session_id)


_HANDLERS = {
    "REPORT_USAGE": _report_usage,
    "ADD_CREDIT": _add_credit,
    "UPSERT_USER": _upsert_user,
    "LOCK_USER": _lock_user,
    "UPDATE_USER": _update_locked_user,
    "DELETE_USER": _delete_user,
}
