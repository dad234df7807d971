"""Minutes in the state store: closed once, late rows kept, state bounded."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.streaming import views as SV
from tollgate.streaming import windowed_activity as WA

BASE = 1_704_067_200_000_000
MIN = 60_000_000


def txns(spark, rows):
    """rows of (minutes since BASE, approved, spent)"""
    df = spark.createDataFrame([(int(m * MIN), a, s) for m, a, s in rows], "t long, approved_amount long, spent_amount long")
    return df.select(F.lit(1).cast("long").alias("userid"), F.lit("x").alias("user_txn_id"),
                     F.timestamp_micros(F.col("t") + F.lit(BASE)).alias("txn_time"), F.lit(None).cast("long").alias("sessionid"),
                     "approved_amount", "spent_amount", F.lit("p").alias("purpose"))


def feed(spark, tmp, rows, watermark="10 minutes"):
    txns(spark, rows).coalesce(2).write.mode("append").parquet(f"{tmp}/in")
    stream = SV.file_stream(spark, f"{tmp}/in", S.TXNS)
    SV.run_to_table(WA.activity_windows(stream, watermark), f"{tmp}/out", f"{tmp}/ck", "append", 120)


def by_hand(rows):
    out = defaultdict(lambda: [None, None, 0, None, None, 0, 0])
    for m, a, s in rows:
        x = out[int(m // 1)]
        x[6] += 1
        if s is not None:
            i = 0 if s <= 0 else 3
            for k, v in ((i, None if a is None else (-a if i == 0 else a)), (i + 1, s)):
                x[k] = v if x[k] is None else x[k] + (v or 0)
            x[i + 2] += 1
    return {k: tuple(v) for k, v in out.items()}


def minutes(df):
    rows = df.select(F.floor((F.unix_micros("txn_time") - F.lit(BASE)) / F.lit(MIN)).alias("m"), *WA.SUMS).collect()
    assert len({r.m for r in rows}) == len(rows)
    return {r.m: tuple(r)[1:] for r in rows}


def test_out_of_order_rows_over_three_runs(spark, tmp_path):
    rng = random.Random(2)
    row = lambda m: (m + rng.random() * 0.99, rng.choice([None, 1, 5]), rng.choice([None, -3, 0, 4]))
    first = [row(rng.randrange(0, 60)) for _ in range(300)]
    second = [row(rng.randrange(0, 90)) for _ in range(200)]      # half of it behind the watermark
    third = [row(500)]
    for part in (first, second, third):
        feed(spark, tmp_path, part)
    every = first + second + third
    assert minutes(WA.activity_minutes(spark, f"{tmp_path}/out", f"{tmp_path}/ck")) == by_hand(every)
    # state: only the last minute is open; files: one final row a minute, late ones apart
    assert set(minutes(WA.open_minutes(spark, f"{tmp_path}/ck"))) == {500}
    final = minutes(WA.closed_minutes(spark, f"{tmp_path}/out", late=False))
    late = WA.closed_minutes(spark, f"{tmp_path}/out", late=True)
    assert set(final) <= set(range(90)) and 0 < late.agg(F.sum("how_many")).first()[0] < len(second)


def test_a_minute_stays_open_until_the_watermark_passes_its_end(spark, tmp_path):
    feed(spark, tmp_path, [(0.5, 1, -1), (10.5, 1, -1)])
    assert set(minutes(WA.open_minutes(spark, f"{tmp_path}/ck"))) == {0, 10}      # watermark at 0:30
    feed(spark, tmp_path, [(0.9, 2, -2), (11.0, 1, -1)])
    assert minutes(WA.closed_minutes(spark, f"{tmp_path}/out")) == {0: (-3, -3, 2, None, None, 0, 2)}
    assert set(minutes(WA.open_minutes(spark, f"{tmp_path}/ck"))) == {10, 11}


def test_parts_are_summed_before_the_shuffle(spark):
    rows = [(i % 3 + 0.1, 1, -1) for i in range(3000)]
    parts = WA.minute_parts(txns(spark, rows).coalesce(1))
    got = parts.collect()
    assert len(got) == 3 and sum(r.how_many for r in got) == 3000
    assert WA.minute_parts(txns(spark, rows).limit(0)).count() == 0
