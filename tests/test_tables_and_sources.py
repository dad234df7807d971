"""Spark-level checks of views, sources and sinks on small literal inputs
(reference quirks Q6, Q8, Q11, Q12, Q15, Q16, Q17)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.operators import latency as H
from tollgate.operators import maintenance as R
from tollgate.operators import runlogs as B
from tollgate.operators import topk as TK
from tollgate.operators import views as V
from tollgate.sources import finevents as FE
from tollgate.sources import messages as MS

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _txns(spark, rows):
    return spark.createDataFrame(rows, S.TXNS)


def _usage(spark, rows):
    return spark.createDataFrame(rows, S.USAGE)


def test_q6_keyed_reservations_never_have_multiple_sessions(spark):
    keyed = _usage(spark, [(1, 5, 10, T0), (1, 6, 11, T0), (2, 7, 10, T0)])
    assert TK.multi_session_ref(keyed).count() == 0
    assert [tuple(r) for r in TK.multi_session_users(keyed).collect()] == [(1, 2)]


def test_q8_current_locks_counts_expired_locks(spark):
    users = spark.createDataFrame([(1, "{}", T0, 10, T0), (2, "{}", T0, 11, T0 + dt.timedelta(hours=5)),
                                   (3, "{}", T0, None, None)], S.USERS)
    as_of = T0 + dt.timedelta(hours=1)
    assert V.current_locks(users).first().how_many == 2
    assert V.current_locks(users, as_of, mode="strict").first().how_many == 1
    unlocked = R.unlock_all(users)
    assert V.current_locks(unlocked).first().how_many == 0


def test_q11_q12_minute_views(spark):
    t = T0 + dt.timedelta(seconds=30)
    txns = _txns(spark, [(1, "a", t, 1, 5, -3, "x"), (1, "b", t, None, 0, 0, "zero credit"),
                         (2, "c", t, None, 0, 7, "credit"), (2, "d", t, None, 0, None, "null"),
                         (1, "e", t, None, 0, 2, "credit")])
    out = V.recent_activity_out(txns).first()
    inn = V.recent_activity_in(txns).first()
    assert (out.approved_amount, out.spent_amount, out.how_many) == (-5, -3, 2)   # zero counts as out
    assert (inn.approved_amount, inn.spent_amount, inn.how_many) == (0, 9, 2)     # NULL in neither
    assert V.cluster_activity(txns).first().how_many == 5
    pruned = R.prune_two(txns, T0 + dt.timedelta(minutes=5))    # two oldest per user go, the roll-up drops
    assert [r.user_txn_id for r in pruned.collect()] == ["e"] and V.cluster_activity(pruned).first().how_many == 1


def test_q15_allocated_credit_null_when_empty(spark):
    empty = _usage(spark, [])
    assert V.allocated_credit(empty).first().allocated_amount is None
    users = spark.createDataFrame([(1, None, None, None, None)], S.USERS)
    assert V.user_allocated(users, empty).first().allocated_amount == 0


def test_q16_histograms(spark):
    lat = spark.createDataFrame([(1, "a", -5, "", 3), (2, "a", 2, "c2", 1), (3, "a", 500, "c3", 2),
                                 (4, "b", 2, "", 1), (5, "b", 7, "c5", 1)], S.LATENCY)
    s = {r.type: r for r in H.latency_summary(lat, max_size=100).collect()}
    assert (s["a"].reports, s["a"].under_reports, s["a"].over_reports) == (6, 1, 1)
    assert (s["a"].max_bucket, s["a"].max_bucket_count, s["a"].total) == (99, 2, 2 + 99 * 2)
    hist = H.latency_histogram(lat, max_size=100)
    diff = {r.bucket: (r.how_many, r.reports) for r in H.histogram_subtract(hist, "a", "b").collect()}
    assert 99 not in diff                                   # the top bucket is dropped
    assert diff[0] == (3, 6) and diff[2] == (0, 6) and diff[7] == (-1, 6)
    sizes = {(r.type, r.size): (r.how_many, r.comment) for r in H.size_histogram(lat, max_size=100).collect()}
    assert ("a", 0) not in sizes and sizes[("a", 99)] == (1, "c3")


def test_percentiles_match_brute_force(spark):
    import random
    rnd = random.Random(5)
    rows = [(i, "t", rnd.randint(-10, 300), "", rnd.randint(1, 3)) for i in range(400)]
    lat = spark.createDataFrame(rows, S.LATENCY)
    got = {r.pct: r.bucket for r in H.latency_percentiles(lat, max_size=250).collect()}
    hist = [0] * 250
    for _, _, v, _, n in rows:
        hist[min(max(v, 0), 249)] += n
    total = sum(hist)
    for p in S.PERCENTILES:
        target, run, match = total * (p / 100), hist[0], 0
        for i in range(1, 250):
            if run >= target:
                break
            match, run = i, run + hist[i]
        assert got[p] == match, p


def test_q17_summary_blocks_follow_the_writer(spark):
    vals = list(range(1, 25))
    line = "2024-01-02 03:04:05:GREPABLE SUMMARY:10:9500.0:" + ":".join(map(str, vals)) + ":"
    lines = spark.createDataFrame([("f", line), ("f", "2024-01-02 03:04:05:noise")], "file string, line string")
    r = B.parse_run_summary(lines).first()
    assert (r.tpms, r.tps, r.rqu_avg, r.kv_put_avg, r.kv_get_avg, r.kv_get_max_freq) == (10, 9500.0, 1, 9, 17, 24)
    assert B.summary_long(B.parse_run_summary(lines)).count() == 24
    assert B.sweep_verdict(B.parse_run_summary(lines)).first().passed is True


def test_real_summary_lines_prefixes_and_rejects(spark):
    block = "812:700:4000:5000:6000:7000:9000:{}:"
    good = "2024-01-02 03:04:05:GREPABLE SUMMARY:10:9500.5:" + block.format("3.0") * 2 + block.format("1.2E7")
    lines = spark.createDataFrame([("f", good), ("g", "ami:t:c5.large:1:Y:charge:8:3:x.log:" + good), ("h", good[:60]),
                                   ("i", good.replace("9500.5", "?")), ("j", good[11:])], "file string, line string")
    rows = {r.file: r for r in B.parse_run_summary(lines).collect()}
    assert [f for f in rows if rows[f].rejected] == ["h", "i", "j"]
    assert rows["f"].run_time == rows["g"].run_time and rows["j"].run_time is None
    assert (rows["g"].rqu_max_freq, rows["g"].kv_get_max_freq, rows["g"].tps) == (3.0, 1.2e7, 9500.5)
    assert B.fleet_total(B.parse_run_summary(lines)).first().clients == 2


def test_run_logs_are_read_from_text_files(spark, tmp_path):
    from tollgate.sources import messages as M
    (tmp_path / "run_a.log").write_text("noise\n2024-01-02 03:04:05:GREPABLE SUMMARY:10:1.0:\n")
    rows = M.summary_lines(M.read_run_logs(spark, str(tmp_path))).collect()
    assert [(r.file, r.line[:10]) for r in rows] == [("run_a.log", "2024-01-02")]


def test_addcredit_decoding_and_rejects(spark):
    msgs = spark.createDataFrame([("T1", '"5","120","T1"'), ("T2", '"x",,'), ("T3", '"6","-4","T3"')],
                                 "key string, value string").withColumn("txn_time", F.lit(T0)) \
        .withColumn("request_id", F.monotonically_increasing_id())
    good = MS.addcredit_requests(msgs).orderBy("txn_id").collect()
    assert [(r.userid, r.amount, r.txn_id, r.op) for r in good] == [(5, 120, "T1", "ADD_CREDIT"),
                                                                     (6, -4, "T3", "ADD_CREDIT")]
    assert MS.addcredit_rejects(msgs).count() == 1


def test_financial_event_sink_is_idempotent_and_tails(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tollgate-fe-", dir="/tmp"), "events")
    ev = spark.createDataFrame([(1, 10, "a", "Added 10", T0), (2, -3, "b", "Spent -3", T0 + dt.timedelta(hours=1))],
                               S.FIN_EVENTS)
    FE.write_financial_events(ev, path, 0)
    FE.write_financial_events(ev, path, 0)          # retried batch
    FE.write_financial_events(ev.limit(1), path, 1)
    assert FE.tail_financial_events(spark, path).count() == 3
    assert FE.tail_financial_events(spark, path, since=T0).count() == 1
    assert FE.topic_retention(ev, T0 + dt.timedelta(hours=2, minutes=30)).count() == 1


def test_run_logs_read_from_text_files(spark):
    d = tempfile.mkdtemp(prefix="tollgate-logs-", dir="/tmp")
    with open(os.path.join(d, "run1.log"), "w") as f:
        f.write("2024-01-02 03:04:05:starting\n")
        f.write("2024-01-02 03:04:05:GREPABLE SUMMARY:10:9500.0:" + ":".join(["1"] * 24) + ":\n")
    logs = MS.read_run_logs(spark, d)
    summary = MS.summary_lines(logs).collect()
    assert len(summary) == 1 and summary[0].file == "run1.log"


def test_zero_divisors_do_not_fail(spark):
    lat = spark.createDataFrame([(1, "z", 5, "", 0)], S.LATENCY)
    assert H.latency_summary(lat).first().average is None
    line = "2024-01-02 03:04:05:GREPABLE SUMMARY:0:10.0:" + ":".join(["1"] * 24) + ":"
    parsed = B.parse_run_summary(spark.createDataFrame([("f", line)], "file string, line string"))
    assert B.sweep_verdict(parsed).first().passed is True


def test_percentiles_of_zero_weight_reports_are_bucket_zero(spark):
    lat = spark.createDataFrame([(1, "z", 40, "", 0), (2, "z", 70, "", 0)], S.LATENCY)
    assert {r.bucket for r in H.latency_percentiles(lat).collect()} == {0}
    s = H.latency_summary(lat).first()
    assert (s.reports, s.max_bucket, s.max_bucket_count) == (0, 70, 0)


def test_kafka_records_are_keyed_by_user(spark):
    import json
    ev = spark.createDataFrame([(7, 10, "a", "Added 10", T0)], S.FIN_EVENTS)
    r = FE.kafka_records(ev).first()
    assert r.key == "7"
    body = json.loads(r.value)
    assert (body["userid"], body["amount"], body["user_txn_id"], body["message"]) == (7, 10, "a", "Added 10")


def test_card_lookup_grows_with_the_purchases(spark):
    from conftest import SF_MID, SF_SMALL

    from tollgate.plans import QUERIES
    small, mid = (QUERIES["find_by_loyalty_card"](spark, sf).count() for sf in (SF_SMALL, SF_MID))
    assert 0 < small and 5 * small < mid < 20 * small


def test_clear_reservations_deletes_all(spark):
    from conftest import SF_SMALL

    from tollgate.operators.maintenance import clear_reservations
    from tollgate.sources import fixtures as fx
    usage = fx.usage_keyed(spark, SF_SMALL)
    assert usage.count() > 0 and clear_reservations(usage).count() == 0
    assert clear_reservations(usage).schema == usage.schema
