import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tollgate.llm import sharding


def test_law_slots_and_edges(make_docs):
    rows = [(i, f"t{i}") for i in range(3000)] + [(None, None), (5, ""), (5, "")]
    out = sharding.shard(make_docs(rows, clash=True), sharding.tree(8), sharding.tree(9), rows_per_run=100).collect()
    assert len(out) == len(rows)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    moved = sum(r.grown_shard == 8 for r in out)
    assert 0.08 < moved / len(out) < 0.15
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.25 * min(counts.values())
    assert {r.size for r in out if r.doc_id is None} == {1}
    assert len({r.shard for r in out if r.doc_id == 5}) == 1


def test_empty(make_docs):
    assert sharding.shard(make_docs([]), sharding.tree(8)).count() == 0


def test_weights_move_only_into_the_subtree_that_gains(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    before, after = sharding.tree(8), sharding.tree(8, {0: 3.0})
    out = keys.select(sharding.place(F.col("k"), before).alias("a"), sharding.place(F.col("k"), after).alias("b")).collect()
    assert all(r.b < 4 for r in out if r.a != r.b)      # region 0 gained weight, region 1 did not
    share = sum(r.b == 0 for r in out) / len(out)
    assert 0.27 < share < 0.33                           # 3 of 10


@pytest.mark.parametrize("n", range(1, 17))
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    out = keys.select(sharding.place(F.col("k"), sharding.tree(n)).alias("a"),
                      sharding.place(F.col("k"), sharding.tree(n + 1)).alias("b")).collect()
    moved = [r for r in out if r.a != r.b]
    assert all(r.b == n for r in moved)
    assert abs(len(moved) / len(out) - 1 / (n + 1)) < 0.015
    sizes = Counter(r.b for r in out)
    assert set(sizes) == set(range(n + 1)) and max(sizes.values()) < 1.25 * min(sizes.values())


def test_placement_is_the_descent_of_the_tree(spark):
    """A walk of its own over the shards' draws: region, rack and shard by the
    largest draw below them."""
    weights = {0: 2.0, 3: 0.5, 6: 0.0}
    tree = sharding.tree(11, weights)
    names = [f"shard{i}" for i in range(11)]
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(sharding.place(F.col("k"), tree).alias("shard"),
                       *[F.xxhash64(F.lit(x), F.col("k")).alias(x) for x in names]).collect()

    def walk(draws):
        def best(shards):
            return max((draws[i] for i in shards if draws[i] is not None), default=-math.inf)
        region = max(range(3), key=lambda g: best(range(4 * g, min(11, 4 * g + 4))))
        rack = max(range(2), key=lambda k: best(range(4 * region + 2 * k, min(11, 4 * region + 2 * k + 2))))
        first = 4 * region + 2 * rack
        return max(range(first, min(11, first + 2)), key=lambda i: best([i]))

    for r in rows:
        draws = [None if weights.get(i, 1.0) == 0 else
                 math.log((((r[x] % 2 ** 64) >> 11) + 1) / float(2 ** 53 + 1)) / weights.get(i, 1.0)
                 for i, x in enumerate(names)]
        assert r.shard == walk(draws)


def test_very_long_text_and_repeated_rows(make_docs):
    out = sharding.shard(make_docs([(1, "ä" * 2_000_000), (1, "ä" * 2_000_000), (2, None)], clash=True),
                         sharding.tree(8), sharding.tree(9)).collect()
    assert sorted(r["size"] for r in out) == [1, 4_000_001, 4_000_001]
    same = [r for r in out if r.doc_id == 1]
    assert len({r.shard for r in same}) == 1 and len({r.slot for r in same}) == 2
