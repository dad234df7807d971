"""The ball-tree search against scoring every document for every item."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import lexical_search as L


def by_hand(docs, items, words_of, k=20):
    """(item place, rank, doc_id, score) by the definition, one pair at a time."""
    terms = [words_of(t) for _, t in docs]
    n_docs, total = sum(bool(w) for w in terms), sum(map(len, terms))
    out = []
    for place, (_, text) in enumerate(items):
        scored = []
        for (doc_id, _), words in zip(docs, terms, strict=True):
            score = 0
            for t in words_of(text):
                df = sum(t in w for w in terms)
                tf = words.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((10 ** 9 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(words) * n_docs) // total)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(place, r, x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def random_docs(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(n)]


@pytest.fixture(scope="module")
def make_items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id bigint, text string")
    return make


def rows_of(df, items):
    places = {i: p for p, i in enumerate(sorted({r.item for r in df.select("item").collect()}))}
    return sorted((places[r.item], r.rank, r.doc_id, r.score) for r in df.collect()), len(places)


@pytest.mark.parametrize("block,leaf", [(8192, 32), (16, 4), (7, 1)])
def test_ranking_equals_brute_force(spark, make_docs, make_items, words_of, block, leaf):
    rng = random.Random(3)
    docs = random_docs(rng, 120) + [(200 + i, "w1 w2 w2 copy") for i in range(30)]   # many ties
    items = [(i, " ".join(rng.choices([f"w{i}" for i in range(70)], k=8))) for i in range(9)] + [(9, "copy W2, w2!")]
    got, n = rows_of(L.rank(make_docs(docs).repartition(3), make_items(items).coalesce(1), block=block, leaf=leaf), items)
    assert n == len(items) and got == sorted(by_hand(docs, items, words_of))


def test_items_in_several_blocks(spark, make_docs, make_items, words_of):
    rng = random.Random(4)
    docs, items = random_docs(rng, 40), [(i, f"w{i} w{i + 1} w3") for i in range(12)]
    got, _ = rows_of(L.rank(make_docs(docs), make_items(items).coalesce(1), item_bytes=20), items)
    assert got == sorted(by_hand(docs, items, words_of))


def test_subtrees_are_pruned_and_bounds_hold():
    """Two far groups: the leaves of the other group are never scored; every
    bound is at least the best score of its ball."""
    rng = np.random.default_rng(0)
    n, width = 512, 40
    indptr = np.arange(0, 6 * n + 1, 6)
    half = np.repeat(np.arange(n) % 2, 6)
    cols = np.concatenate([rng.permutation(20)[:6] for _ in range(n)]) + 20 * half
    values = rng.integers(1, 10 ** 6, 6 * n)
    weights = rng.integers(1, 9000, width)
    scale = np.sqrt(weights.astype(float))
    tree = L.build_tree(indptr, cols, values, scale, 8)
    assert sorted(tree.order.tolist()) == list(range(n))
    leaves = int((tree.child < 0).sum())
    item = L.Item(0, np.array([1, 3, 5, 19]), np.array([1, 2, 1, 1]))
    best = L.Best(20)
    scored = L.search(tree, item, weights, scale, list(range(n)), best)
    assert 0 < scored <= leaves // 2 + 1
    dense = np.zeros(width, np.int64)
    dense[item.terms] = item.repeats * weights[item.terms]
    exact = np.add.reduceat(values * dense[cols], indptr[:-1])
    want = sorted((-int(s), False, i) for i, s in enumerate(exact) if s > 0)[:20]
    assert best.rows == want
    bounds = L.bounds_of(tree, item, scale)
    for node in range(len(tree.lo)):
        assert bounds[node] >= exact[tree.order[tree.lo[node]:tree.hi[node]]].max()


def test_a_ball_of_copies_has_almost_no_radius():
    indptr, cols = np.arange(0, 301, 3), np.tile([0, 4, 7], 100)
    tree = L.build_tree(indptr, cols, np.tile([5, 10 ** 6, 7], 100), np.ones(9), 8)
    assert tree.radius.max() < 1


def test_nulls_repeats_long_texts_empty_tables(spark, make_docs, make_items, words_of):
    docs = [(1, None), (2, ""), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (4, "beta " * 300_000),
            (5, "gamma ... GAMMA"), (6, "ünïcode é")]
    items = [(1, "Alpha"), (1, "Alpha"), (None, "beta beta"), (7, None), (8, " . "), (9, "nothing"), (10, "É é ünïcode")]
    df = L.rank(make_docs(docs, clash=True), make_items(items).coalesce(1).withColumn("score", F.lit(1)))
    assert df.columns == ["item", "item_id", "rank", "doc_id", "score"]
    want = [(items[p][0], r, d, s) for p, r, d, s in by_hand(docs, items, words_of)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=key) == sorted(want, key=key)
    none = make_docs(docs).limit(0)
    assert L.rank(none, make_items(items)).count() == 0
    assert L.rank(make_docs([(1, None), (2, " ")]), make_items(items)).count() == 0
    assert L.rank(make_docs(docs), make_items(items).limit(0)).count() == 0
