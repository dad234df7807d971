import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tollgate.llm import exact_dedup

ROWS = [(1, "Abc"), (2, "aBC"), (3, "abç"), (4, "ABÇ"), (5, None), (6, ""), (6, ""), (None, "abc"), (None, None),
        (7, "x" * 300_000), (8, "X" * 300_000), (9, "y"), (9, "y"), (9, "z")]


def brute(rows):
    groups = defaultdict(list)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        groups[low(t)].append(i)
    return sorted((str(i), str(max((x for x in groups[low(t)] if x is not None), default=None)), len(groups[low(t)]))
                  for i, t in rows)


@pytest.mark.parametrize("key_bits", [64, 3])
@pytest.mark.parametrize("clash", [False, True])
def test_edges_and_collisions(make_docs, key_bits, clash):
    got = exact_dedup.exact_dedup(make_docs(ROWS, clash), capacity=2, key_bits=key_bits).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == brute(ROWS)
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    assert kept == sorted(["2", "3", "4", "6", "8", "9", "9"])  # one of each group, also of repeated rows


def test_empty_table(make_docs):
    assert exact_dedup.exact_dedup(make_docs([])).count() == 0
    assert exact_dedup.keep_first(make_docs([])).count() == 0


def test_directory_splits_only_overfull_buckets(make_docs):
    r = random.Random(3)
    docs = make_docs([(i, f"text {r.random()}") for i in range(400)])
    _, index = exact_dedup.build_index(docs, capacity=40)
    assert index.groupBy("bucket", "local_depth").count().agg({"count": "max"}).first()[0] <= 40
    assert index.count() == 400
    assert {x.local_depth for x in index.select("local_depth").distinct().collect()} <= set(range(1, 8))


@pytest.mark.parametrize("key_bits", [64, 6])
def test_documents_are_found_through_the_directory(make_docs, key_bits):
    """With a directory that names wrong buckets documents are lost; with the right one none is."""
    docs = make_docs([(i, f"text {i % 150}") for i in range(300)])
    (bits, places), index = exact_dedup.build_index(docs, capacity=20, key_bits=key_bits)
    assert exact_dedup.lookup(docs, (bits, places), index, key_bits).count() == 300
    moved = places.withColumn("bucket", F.when(F.col("bucket") == places.agg({"bucket": "max"}).first()[0], 0).otherwise(F.col("bucket")))
    lost = exact_dedup.lookup(docs, (bits, moved), index, key_bits).count()
    assert 0 < lost < 300


def test_chains_hold_their_texts_and_owners_ranges_of_keys(make_docs):
    docs = make_docs([(i, f"text {i % 90}") for i in range(180)])
    _, index = exact_dedup.build_index(docs, capacity=8, key_bits=4)
    assert index.where("links > 1 AND norm IS NULL").count() == 0 and index.where("links = 1 AND norm IS NOT NULL").count() == 0
    assert index.count() == 90 and index.groupBy("key").count().count() <= 16
    bad = index.groupBy("key").agg(F.max("chain").alias("top"), F.count("*").alias("n"), F.max("links").alias("links"))
    assert bad.where("top <> n OR links <> n").count() == 0


def test_stage_keeps_columns_and_one_of_each(make_docs):
    out = exact_dedup.keep_first(make_docs(ROWS, clash=True))
    assert out.columns == make_docs(ROWS, clash=True).columns
    assert sorted((str(r.doc_id), (r.text or "")[:3]) for r in out.collect()) == sorted(
        [("2", "aBC"), ("3", "abç"), ("4", "ABÇ"), ("6", ""), ("8", "XXX"), ("9", "y"), ("9", "z")])
