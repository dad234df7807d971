"""The streaming replay equals the batch replay, survives a restart from
its checkpoint, and sends rows older than a user's state to the late output."""

import os
import tempfile

from conftest import SF_SMALL
from pyspark.sql import functions as F

from tollgate.operators import charge as D
from tollgate.sources import fixtures as fx
from tollgate.streaming import charge_stream as CS

COLS = ["request_id", "userid", "txn_time", "op", "status", "status_text", "session_id", "approved", "spent",
        "balance_after", "allocated_after"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_stream_with_restart_equals_batch_and_reports_late_rows(spark):
    root = tempfile.mkdtemp(prefix="tollgate-stream-", dir="/tmp")
    inbox, out, state = (os.path.join(root, x) for x in ("in", "out", "state"))
    req = fx.requests(spark, SF_SMALL).withColumn("_t", F.unix_micros("txn_time"))
    mid = req.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _t)")).first()[0]
    users, opening = fx.users(spark, SF_SMALL), fx.opening_events(spark, SF_SMALL)

    first = req.filter(F.col("_t") < mid).drop("_t")
    second = req.filter(F.col("_t") >= mid).drop("_t")
    first.write.parquet(inbox)
    CS.run_available(CS.request_stream(spark, inbox), out, state, users=users, opening_events=opening)
    after_first = CS.read_charge_outputs(spark, out).select("batch_id").distinct().count()
    second.write.mode("append").parquet(inbox)
    CS.run_available(CS.request_stream(spark, inbox), out, state, users=users, opening_events=opening)

    result = CS.read_charge_outputs(spark, out)
    assert after_first == 1 and result.select("batch_id").distinct().count() == 2
    batch = D.charge(req.drop("_t"), users=users, opening_events=opening)
    assert _rows(CS.decisions_of(result)) == _rows(batch.decisions)
    ev_cols = ["request_id", "userid", "amount", "user_txn_id", "message", "txn_time"]
    assert (sorted(tuple(r) for r in CS.events_of(result).select(*ev_cols).collect())
            == sorted(tuple(r) for r in batch.events_with_request.select(*ev_cols).collect()))

    # replaying old rows again: they are late, reported, and change nothing
    first.limit(25).write.mode("append").parquet(inbox)
    CS.run_available(CS.request_stream(spark, inbox), out, state, users=users, opening_events=opening)
    result = CS.read_charge_outputs(spark, out)
    late = CS.late_of(result)
    cols = sorted(late.columns)
    sent = spark.read.schema(req.drop("_t").schema).parquet(inbox).select(*cols)
    assert late.count() == 25 and late.select(*cols).exceptAll(sent).count() == 0  # with all their columns
    assert _rows(CS.decisions_of(result)) == _rows(batch.decisions)


def test_streaming_dedup_keeps_one_request_per_key(spark):
    from tollgate.streaming import views as SV
    root = tempfile.mkdtemp(prefix="tollgate-dedup-", dir="/tmp")
    req = fx.requests(spark, SF_SMALL).filter(F.col("txn_id").isNotNull())
    req.write.parquet(os.path.join(root, "in"))
    SV.run_to_table(SV.dedup_requests_stream(SV.file_stream(spark, os.path.join(root, "in"), req.schema)),
                    os.path.join(root, "out"), os.path.join(root, "ck"), "append")
    out = spark.read.parquet(os.path.join(root, "out"))
    assert out.count() == req.select("userid", "txn_id").distinct().count()
    assert out.groupBy("userid", "txn_id").count().filter("count > 1").count() == 0


def test_stream_in_four_micro_batches_equals_batch(spark):
    """One run, four micro-batches (one time slice per file, one file per
    trigger): state carries across batches inside a run."""
    root = tempfile.mkdtemp(prefix="tollgate-mb-", dir="/tmp")
    req = fx.requests(spark, SF_SMALL).withColumn("_t", F.unix_micros("txn_time"))
    qs = req.approxQuantile("_t", [0.25, 0.5, 0.75], 0.0)
    edges = [None, *qs, None]
    for i in range(4):
        part = req
        if edges[i] is not None:
            part = part.filter(F.col("_t") >= edges[i])
        if edges[i + 1] is not None:
            part = part.filter(F.col("_t") < edges[i + 1])
        part.drop("_t").coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
    users, opening = fx.users(spark, SF_SMALL), fx.opening_events(spark, SF_SMALL)
    CS.run_available(CS.request_stream(spark, os.path.join(root, "in"), max_files_per_trigger=1),
                     os.path.join(root, "out"), os.path.join(root, "state"), users=users, opening_events=opening)
    out = CS.read_charge_outputs(spark, os.path.join(root, "out"))
    assert out.select("batch_id").distinct().count() == 4 and CS.late_of(out).count() == 0
    batch = D.charge(req.drop("_t"), users=users, opening_events=opening)
    assert _rows(CS.decisions_of(out)) == _rows(batch.decisions)


def test_minutes_hold_rows_behind_the_watermark(spark):
    from tollgate.streaming import views as SV
    root = tempfile.mkdtemp(prefix="tollgate-minutes-", dir="/tmp")
    inbox, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    tx = fx.txns(spark, SF_SMALL)
    t = F.col("txn_time")
    mid = F.lit("2024-01-01 02:00:00").cast("timestamp")
    held = F.pmod(F.xxhash64("user_txn_id"), F.lit(5)) == 0
    for part in ((t < mid) & ~held, t >= mid, (t < mid) & held):  # the last part is behind
        tx.filter(part).write.mode("append").parquet(inbox)
        SV.activity_per_minute_stream(SV.file_stream(spark, inbox, tx.schema), out, ck)
    minute = F.date_trunc("minute", t).alias("txn_time")
    counts = lambda df: sorted(tuple(r) for r in df.groupBy(minute).count().collect())
    of = lambda df: sorted(tuple(r) for r in df.select("txn_time", "how_many").collect())
    assert of(SV.activity_minutes(spark, out)) == counts(tx)
    assert of(SV.late_minutes(spark, out)) == counts(tx.filter((t < mid) & held)) != []
