"""Views kept by signed changes: equal to recomputation, stored rows not shuffled."""

import random

from conftest import SF_SMALL
from oracle_compare import compare, duck
from pyspark.sql import functions as F

from tollgate.operators import incremental as I
from tollgate.operators import maintenance as R
from tollgate.operators import views as V
from tollgate.plans import ORACLES, QUERIES

USAGE = "userid long, allocated_amount long, sessionid long, lastdate timestamp"


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_query_equals_recomputation(spark):
    r = compare(QUERIES["kept_views"](spark, SF_SMALL), duck(SF_SMALL), ORACLES["kept_views"])
    assert r["ok"], r


def test_random_batches_with_nulls_and_a_hot_user(spark, tmp_path):
    r = random.Random(5)
    views = I.KeptViews(spark, str(tmp_path), 4, {k: I.VIEWS[k] for k in ("allocated", "sessions")})
    alive, n = [], 0
    for _ in range(4):
        new = [(r.choice([1, 1, 1, 2, 3, 4, None]), r.choice([None, 0, 5, 7]), r.choice([1, 2, None]), None)
               for _ in range(60)]
        gone = [alive.pop(r.randrange(len(alive))) for _ in range(min(len(alive), 50))]
        alive += new
        n += 1
        changes = I.added(spark.createDataFrame(new, USAGE))
        if gone:
            changes = changes.unionByName(I.removed(spark.createDataFrame(gone, USAGE)))
        views.apply({"usage": changes})
        now = spark.createDataFrame(alive, USAGE)
        assert _rows(views.users_sessions()) == _rows(V.users_sessions(now))
        assert _rows(views.allocated_credit()) == _rows(V.allocated_credit(now))
    views.apply({"usage": I.removed(spark.createDataFrame(alive, USAGE))})
    assert views.users_sessions().count() == 0
    assert _rows(views.allocated_credit()) == ["(None,)"]      # no reservations: NULL
    assert views.version == {"allocated": n, "sessions": n}


def test_empty_batch_and_empty_table(spark, tmp_path):
    views = I.KeptViews(spark, str(tmp_path), 2, {"allocated": I.VIEWS["allocated"]})
    none = I.added(spark.createDataFrame([], USAGE))
    views.apply({"usage": none})
    assert _rows(views.allocated_credit()) == ["(None,)"]
    views.apply({"usage": I.added(spark.createDataFrame([(1, 4, 1, None)], USAGE))})
    views.apply({"usage": none, "txns": none})
    assert _rows(views.allocated_credit()) == ["(4,)"]


def test_a_batch_run_again_counts_once(spark, tmp_path):
    views = I.KeptViews(spark, str(tmp_path), 2, {"allocated": I.VIEWS["allocated"]})
    views.apply({"usage": I.added(spark.createDataFrame([(1, 4, 1, None)], USAGE))})
    batch = I.added(spark.createDataFrame([(1, 3, 1, None)], USAGE))
    views.apply({"usage": batch})
    views.version["allocated"] -= 1           # the driver was lost before it noted the new version
    views.apply({"usage": batch})
    assert _rows(views.allocated_credit()) == ["(7,)"]


def test_only_changes_are_shuffled(spark, tmp_path):
    """The merge has exchanges over the changes alone, and reading the view has none."""
    views = I.KeptViews(spark, str(tmp_path), 4, {k: I.VIEWS[k] for k in ("allocated", "sessions", "known")})
    usage = spark.range(2000).select((F.col("id") % 300).alias("userid"), F.col("id").alias("allocated_amount"),
                                     (F.col("id") % 7).alias("sessionid"), F.current_timestamp().alias("lastdate"))
    views.apply({"usage": I.added(usage), "users": I.added(usage.select("userid").distinct())})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("allocated", "sessions"):
            plan = views.planned(name, I.removed(usage.limit(5)))._jdf.queryExecution().executedPlan()
            side = plan.toString().split("kept_" + name)[0]
            stored = side[side.index("SortMergeJoin"):]
            assert "Exchange" not in stored, stored
        for df in (views.user_allocated(), views.users_sessions()):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_changes_are_what_the_snapshots_drop(spark):
    from tollgate.sources import fixtures as fx
    txns, as_of = fx.txns(spark, SF_SMALL), fx.METRICS_AS_OF_US
    for changes, kept in ((I.ttl_txns_changes(txns, as_of), R.ttl_txns(txns, as_of)),
                          (I.prune_two_changes(txns, as_of), R.prune_two(txns, as_of)),
                          (I.prune_oldest_changes(txns, as_of), R.prune_oldest(txns, as_of))):
        gone = changes.drop("sign")
        assert gone.count() > 0 and _rows(gone) == _rows(txns.exceptAll(kept))
