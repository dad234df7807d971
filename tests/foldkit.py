"""Tiny helpers to drive the pure-Python fold in rule tests."""

from tollgate.operators.fold import Output, Request, UserState, step

T0 = 1_704_067_200_000_000          # 2024-01-01 00:00:00 UTC in microseconds
SEC = 1_000_000
MIN = 60 * SEC


def user(balance=1000, json='{"mysteriousHexPayload":"1","loyaltySchemeName":"HelperCard","loyaltySchemeNumber":1}'):
    st = UserState()
    st.exists = True
    st.json = json
    st.last_seen = T0
    st.balance = balance
    return st


class Log:
    """Applies requests to one user's state and keeps the decisions/events."""

    def __init__(self, st=None, uid=1, mode="reference"):
        self.st = st if st is not None else user()
        self.uid = uid
        self.mode = mode
        self.n = 0
        self.out = Output()

    def __call__(self, op, t=0, **kw):
        self.n += 1
        r = Request(kw.pop("request_id", self.n), T0 + t, op, **kw)
        before = len(self.out.d["request_id"])
        step(self.st, self.uid, r, self.out, self.mode)
        d = {c: v[before] for c, v in self.out.d.items()}
        return d

    def usage(self, **kw):
        return self("REPORT_USAGE", **kw)

    def credit(self, **kw):
        return self("ADD_CREDIT", **kw)

    @property
    def events(self):
        e = self.out.e
        return list(zip(e["amount"], e["user_txn_id"], e["message"]))
