"""Views kept up to date by signed changes (A2-A5, A8 under R1-R5).

A change is a row of a state table with a ``sign``: +1 put in, -1 taken out by
a delete, a prune or the TTL.  The views are counts and sums, so the change of
a view is the signed count and sum of the changed rows, and no unchanged row
is read again.

A view is stored as a table bucketed and sorted by its keys.  A batch of
changes is added up per key, first where it lies, then shuffled into the
view's buckets and merged with the stored rows by a full outer join that moves
no stored row.  Each batch writes a new version from the one before, so a
batch that failed is run again from the same version and counts once.

Rows without a user id are no user's: they match no stored row, lie beside
them and are added up when the view is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.columns import date_shift, ts_literal
from tollgate.operators.topk import oldest_txn_per_user, two_oldest_stale_txns


class View(NamedTuple):
    """``relation`` whose rows are counted per ``keys``, and ``measure``, a column
    summed beside the count.  The sum is NULL where no row has a value, so the
    rows that have one are counted too."""
    relation: str
    keys: tuple[str, ...]
    measure: str | None = None


VIEWS = {
    "balance": View("fin_events", ("userid",), "amount"),                 # A2
    "allocated": View("usage", ("userid",), "allocated_amount"),          # A3, A4
    "sessions": View("usage", ("userid", "sessionid")),                   # A5
    "ledger": View("txns", ("userid",)),                                  # A8
    "known": View("users", ("userid",)),                                  # users of A4
}


# ------------------------------------------------------------- the changes ---

def added(df: DataFrame) -> DataFrame:
    return df.withColumn("sign", F.lit(1).cast("long"))


def removed(df: DataFrame) -> DataFrame:
    return df.withColumn("sign", F.lit(-1).cast("long"))


def _expired(time: str, cutoff: Column) -> Column:
    """What the TTL does not keep; a row without a time is not kept either."""
    return ~F.coalesce(F.col(time) >= cutoff, F.lit(False))


def ttl_usage_changes(usage: DataFrame, as_of, minutes: int = S.USAGE_TTL_MINUTES) -> DataFrame:
    """R1 as changes: the reservations it drops (one filter, no shuffle)."""
    return removed(usage.filter(_expired("lastdate", date_shift(ts_literal(as_of), minutes=-minutes))))


def ttl_txns_changes(txns: DataFrame, as_of, seconds: int = S.TXN_TTL_SECONDS) -> DataFrame:
    """R2 as changes: the ledger rows it drops."""
    return removed(txns.filter(_expired("txn_time", date_shift(ts_literal(as_of), seconds=-seconds))))


def prune_two_changes(txns: DataFrame, as_of) -> DataFrame:
    """R3 as changes: each user's two oldest stale rows.  A ledger holds a
    (userid, user_txn_id) once."""
    return removed(two_oldest_stale_txns(txns, as_of).select(*txns.columns))


def prune_oldest_changes(txns: DataFrame, as_of, age_seconds: int = S.PRUNE_OLDEST_AGE_SECONDS) -> DataFrame:
    """R4 as changes: each user's oldest row when older than five minutes."""
    cutoff = date_shift(ts_literal(as_of), seconds=-age_seconds)
    return removed(oldest_txn_per_user(txns).filter(F.col("txn_time") < cutoff).select(*txns.columns))


def delete_users_changes(state: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """R5 as changes: what the users own in every relation but the exported
    events, which stay (Q18)."""
    doomed = ids.select(F.col(ids.columns[0]).alias("userid")).distinct()
    return {name: removed(df.join(doomed, "userid", "left_semi"))
            for name, df in state.items() if name != "fin_events"}


# --------------------------------------------------------------- the views ---

def _totals(changes: DataFrame, view: View) -> DataFrame:
    """Signed totals per key of changed rows (a partial aggregate first)."""
    sign = F.col("sign")
    value = F.col(view.measure) if view.measure else F.lit(None).cast("long")
    return changes.groupBy(*view.keys).agg(
        F.sum(sign).alias("n"),
        F.coalesce(F.sum(value * sign), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum(F.when(value.isNotNull(), sign)), F.lit(0)).alias("n_valued"))


_SUMS = ("n", "total", "n_valued")


def merged(stored: DataFrame, changes: DataFrame, view: View, buckets: int) -> DataFrame:
    """The rows of the view after the changes.  ``stored`` is bucketed by the
    keys, so only the changes are shuffled."""
    delta = _totals(changes, view).repartition(buckets, *view.keys)
    s, d = stored.alias("s"), delta.alias("d")
    on = [F.col(f"s.{k}") == F.col(f"d.{k}") for k in view.keys]
    both = s.join(d, on, "full_outer").select(
        *[F.coalesce(f"s.{k}", f"d.{k}").alias(k) for k in view.keys],
        *[(F.coalesce(f"s.{c}", F.lit(0)) + F.coalesce(f"d.{c}", F.lit(0))).cast("long").alias(c) for c in _SUMS])
    return both.filter((F.col("n") != 0) | (F.col("total") != 0) | (F.col("n_valued") != 0))


class KeptViews:
    """The stored views of one state.  ``apply`` takes, per relation, the changed rows
    of a batch; the methods named like the views read them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, views: dict[str, View] | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.views = dict(VIEWS if views is None else views)
        self.run = uuid.uuid4().hex[:12]
        self.version = dict.fromkeys(self.views, -1)

    def _table(self, name: str, version: int) -> str:
        return f"kept_{name}_{self.run}_{version}"

    def _write(self, name: str, rows: DataFrame) -> None:
        version, keys = self.version[name] + 1, self.views[name].keys
        (rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys)
         .option("path", f"{self.path}/{name}/v{version}").saveAsTable(self._table(name, version)))
        self.version[name] = version

    def stored(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name, self.version[name]))

    def apply(self, changes: dict[str, DataFrame]) -> None:
        """One batch: a new version of every view over a changed relation."""
        for name, view in self.views.items():
            if view.relation in changes:
                self._write(name, self.planned(name, changes[view.relation]))

    def planned(self, name: str, changes: DataFrame) -> DataFrame:
        """The next version of a view, not yet written."""
        view = self.views[name]
        if self.version[name] < 0:
            return _totals(changes, view).repartition(self.buckets, *view.keys)
        return merged(self.stored(name), changes, view, self.buckets)

    def _read(self, name: str, keys: Sequence[str]) -> DataFrame:
        sums = self.stored(name).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
        return sums.filter(F.col("n") > 0) if keys else sums

    @staticmethod
    def _sum() -> Column:
        return F.when(F.col("n_valued") > 0, F.col("total"))

    def user_balance(self) -> DataFrame:
        """A2."""
        return self._read("balance", ["userid"]).select("userid", self._sum().alias("balance"))

    def allocated_credit(self) -> DataFrame:
        """A3: one row, NULL without reservations (Q15)."""
        return self._read("allocated", []).select(self._sum().alias("allocated_amount"))

    def user_allocated(self) -> DataFrame:
        """A4: 0 for a user without reservations; both sides lie in the same buckets."""
        per_user = self._read("allocated", ["userid"]).select("userid", self._sum().alias("allocated_amount"))
        return (self._read("known", ["userid"]).select("userid").join(per_user, "userid", "left")
                .select("userid", F.coalesce("allocated_amount", F.lit(0)).cast("long").alias("allocated_amount")))

    def users_sessions(self) -> DataFrame:
        """A5."""
        return self._read("sessions", ["userid", "sessionid"]).select("userid", "sessionid", F.col("n").alias("how_many"))

    def cluster_activity_by_users(self) -> DataFrame:
        """A8."""
        return self._read("ledger", ["userid"]).select("userid", F.col("n").alias("how_many"))
