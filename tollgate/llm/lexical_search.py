r"""Ranked lexical search: exact inner-product search in sparse ball trees.

The score of a document for an item is the sum, over the item's terms with
repeats, of ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))``, with
``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and
``m = 75 + (25 n N) div L``: an inner product of a sparse item vector and a
sparse document vector.

1. One pass over the texts gives each document its number of terms and the
   counts of the terms that some item asks for (no other term adds to a score).
   It is stored; N, L and df are partial aggregates of it.
2. Every task takes its documents in blocks of ``BLOCK_DOCS``, builds a ball
   tree over each block (a ball: centroid and radii of a subtree), and searches
   it best-first for every item.  By Cauchy and Schwarz no document of a ball
   scores more than ``q . centroid + |q| * radius``, where ``q`` is the item
   without the terms that no document of the ball holds.  The radius is taken in
   each of ``GROUPS`` groups of terms of like weight, and the products are added
   up, which is never more and mostly much less.  All is rounded up by a bound of
   the floating-point error, so a subtree is left out only where all its
   documents score less than the item's current last place.  The documents of a
   leaf are scored in 64-bit integers.
3. The best of all tasks are ranked in two salted steps.

Items come in blocks of about ``ITEM_BYTES`` of text; each block is searched
against all documents, so what a task is given stays bounded.

Terms are ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``, A-Z lower-cased.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import stored
from tollgate.llm.words import cut
from tollgate.operators.keyed import top_k_per_key

TOP = 20
#: documents of a tree, and of a leaf
BLOCK_DOCS = 8192
LEAF_DOCS = 32
#: groups of terms with a radius of their own
GROUPS = 16
#: text of the items that are searched at once
ITEM_BYTES = 128 * 1024
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: half the distance of 1 to the next double
UNIT = 2.0 ** -53


def terms_of(text: str | bytes | None) -> Counter:
    """Terms of a text with their counts, a bounded piece at a time."""
    out: Counter = Counter()
    raw = text.encode() if isinstance(text, str) else text or b""
    for piece in cut(raw):
        out.update(_TERM.findall(piece.lower()))
    return out


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of terms of each document, and which
    terms of ``vocabulary`` it holds how often."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType(), False),
                           T.StructField("terms", T.ArrayType(T.IntegerType(), False), False),
                           T.StructField("tfs", T.ArrayType(T.LongType(), False), False)])

    def run(batches):
        known = vocabulary.keys()
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                held = found.keys() & known
                ns.append(found.total())
                terms.append([vocabulary[t] for t in held])
                tfs.append([found[t] for t in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Item(NamedTuple):
    item: int
    terms: np.ndarray      # positions in the vocabulary
    repeats: np.ndarray    # of each term in the item


class Tree(NamedTuple):
    order: np.ndarray      # rows of the block, leaf by leaf
    indptr: np.ndarray     # of the rows in that order
    cols: np.ndarray
    values: np.ndarray     # integer parts of the scores
    lo: np.ndarray         # rows of each node, as places in ``order``
    hi: np.ndarray
    child: np.ndarray      # first of two neighbouring children, -1 at a leaf
    centroid: np.ndarray
    group: np.ndarray      # of each column
    radius: np.ndarray     # of each node in each group


def _rows(indptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows`` one after the other, and where each row starts there."""
    lengths = indptr[rows + 1] - indptr[rows]
    starts = np.cumsum(lengths) - lengths
    return np.repeat(indptr[rows] - starts, lengths) + np.arange(int(lengths.sum())), starts


def build_tree(indptr: np.ndarray, cols: np.ndarray, values: np.ndarray, scale: np.ndarray, leaf: int = LEAF_DOCS,
               groups: int = GROUPS) -> Tree:
    """Ball tree of sparse rows (each with at least one entry).  A ball is cut
    at the middle of its rows along the line from the row farthest from its
    centroid to the row farthest from that one, so it is balanced and ties and
    equal rows do no harm.  ``scale`` weighs the columns: distances are those of
    ``values * scale``."""
    x = values * scale[cols]
    width = len(scale)
    group = np.empty(width, np.int64)
    group[np.argsort(scale, kind="stable")] = np.arange(width) * groups // max(width, 1)
    in_group = group[cols]
    order = np.arange(len(indptr) - 1)
    lo, hi, child, centroids, radii = [0], [len(order)], [-1], [], []
    node = 0
    slack = 4 * (width + 16) * UNIT
    while node < len(lo):
        rows = order[lo[node]:hi[node]]
        n = len(rows)
        at, starts = _rows(indptr, rows)
        c, v = cols[at], x[at]
        centre = np.bincount(c, weights=v, minlength=width) / n
        cell = np.repeat(np.arange(n), indptr[rows + 1] - indptr[rows]) * groups + in_group[at]
        square = np.bincount(cell, weights=v * v, minlength=n * groups).reshape(n, groups)
        dot = np.bincount(cell, weights=v * centre[c], minlength=n * groups).reshape(n, groups)
        cc = np.bincount(group, weights=centre * centre, minlength=groups)
        far = square - 2 * dot + cc
        # all terms of the distance are at least 0, so their sum bounds the error of the difference
        upper = np.maximum(far, 0) + slack * (square + 2 * dot + cc)
        centroids.append(centre)
        radii.append(np.sqrt(upper.max(axis=0)) * (1 + 8 * UNIT))
        if n > leaf:
            dense = np.zeros(width)
            a = int(np.argmax(far.sum(axis=1)))
            mine = slice(indptr[rows[a]], indptr[rows[a] + 1])
            dense[cols[mine]] = x[mine]
            to_a = np.add.reduceat(v * dense[c], starts)
            b = int(np.argmax(square.sum(axis=1) - 2 * to_a))
            other = slice(indptr[rows[b]], indptr[rows[b] + 1])
            dense[cols[mine]] = 0.0
            dense[cols[other]] = x[other]
            along = to_a - np.add.reduceat(v * dense[c], starts)
            half = n // 2
            order[lo[node]:hi[node]] = rows[np.argpartition(along, half)]
            child[node] = len(lo)
            mid = lo[node] + half
            lo += [lo[node], mid]
            hi += [mid, hi[node]]
            child += [-1, -1]
        node += 1
    at, starts = _rows(indptr, order)
    return Tree(order, np.append(starts, len(at)), cols[at], values[at], np.array(lo), np.array(hi), np.array(child),
                np.array(centroids), group, np.array(radii))


def bounds_of(tree: Tree, item: Item, scale: np.ndarray) -> np.ndarray:
    """For each ball, a number that no score of its documents exceeds."""
    q = item.repeats * scale[item.terms]
    centre = tree.centroid[:, item.terms]
    groups = tree.radius.shape[1]
    length = np.zeros((len(centre), groups))
    held = (centre > 0) * (q * q)
    for g in range(groups):
        length[:, g] = held[:, tree.group[item.terms] == g].sum(axis=1)
    up = 1 + 16 * (len(scale) + 16) * UNIT
    return (centre @ q + (np.sqrt(length) * tree.radius).sum(axis=1)) * up + 1e-6


class Best:
    """The best rows of an item so far: (-score, id is null, id), ascending."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def bar(self) -> int:
        """The least score that may still come in."""
        return 1 if len(self.rows) < self.k else max(1, -self.rows[-1][0])

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted([*self.rows, *rows])[:self.k]


def search(tree: Tree, item: Item, weights: np.ndarray, scale: np.ndarray, ids: list, best: Best) -> int:
    """Puts the best documents of the tree into ``best``; the number of leaves
    that were scored."""
    bounds = bounds_of(tree, item, scale)
    dense = np.zeros(len(scale), np.int64)
    dense[item.terms] = item.repeats * weights[item.terms]
    heap = [(-float(bounds[0]), 0)]
    scored = 0
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < best.bar:
            break
        first = int(tree.child[node])
        if first >= 0:
            for c in (first, first + 1):
                b = min(-bound, float(bounds[c]))
                if b >= best.bar:
                    heapq.heappush(heap, (-b, c))
            continue
        scored += 1
        lo, hi = int(tree.lo[node]), int(tree.hi[node])
        a, z = tree.indptr[lo], tree.indptr[hi]
        scores = np.add.reduceat(tree.values[a:z] * dense[tree.cols[a:z]], tree.indptr[lo:hi] - a)
        hit = np.flatnonzero(scores >= best.bar)
        if len(hit):
            best.add([(-int(scores[i]), ids[j] is None, ids[j]) for i, j in
                      zip(hit.tolist(), tree.order[lo + hit].tolist(), strict=True)])
    return scored


def search_documents(counted: DataFrame, items: list[Item], weights: np.ndarray, n_docs: int, n_terms: int,
                     k: int = TOP, block: int = BLOCK_DOCS, leaf: int = LEAF_DOCS) -> DataFrame:
    """(item, doc_id, score): the best ``k`` of each task for each item."""
    scale = np.sqrt(weights.astype(np.float64))
    schema = T.StructType([T.StructField("item", T.LongType(), False), counted.schema["doc_id"],
                           T.StructField("score", T.LongType(), False)])

    def run(batches):
        best = [Best(k) for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                lists, tfs = part.column(2), part.column(3)
                lengths = np.diff(lists.offsets.to_numpy())
                indptr = np.append(0, np.cumsum(lengths)).astype(np.int64)
                m = [75 + 25 * n * n_docs // n_terms for n in part.column(1).to_pylist()]
                tf = tfs.flatten().to_numpy().astype(np.int64)
                values = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(np.array(m, np.int64), lengths))
                tree = build_tree(indptr, lists.flatten().to_numpy().astype(np.int64), values, scale, leaf)
                ids = part.column(0).to_pylist()
                for item, found in zip(items, best, strict=True):
                    search(tree, item, weights, scale, ids, found)
        rows = [(item.item, r[2], -r[0]) for item, found in zip(items, best, strict=True) for r in found.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], batch_type),
             pa.array([r[2] for r in rows], pa.int64())], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type
    batch_type = to_arrow_type(schema["doc_id"].dataType)
    return counted.where(F.size("terms") > 0).mapInArrow(run, schema)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES, block: int = BLOCK_DOCS,
         leaf: int = LEAF_DOCS) -> DataFrame:
    """The ``k`` highest-scoring documents of ``docs`` (doc_id, text) for each
    row of ``items`` (item_id, text): item, item_id, rank from 1, doc_id, score.

    Null and empty texts have no terms: such a document is in no count and no
    result, such an item has no rows.  Equal scores go by ascending doc_id, null
    last.  Repeated rows, and rows that share a doc_id, are documents of their
    own; repeated items are items of their own (``item`` numbers them).  Very
    long texts are counted in pieces, wholly.  An empty table on either side
    gives no rows.  Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    asked = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "search-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // item_bytes)
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()
        found = [(r["item"], terms_of(r["text"])) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in found))))}
        if not vocabulary:
            continue
        counted = stored(count_terms(docs, vocabulary), "search-counts")
        n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        wanted = [Item(i, np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64))
                  for i, c in found if c]
        parts.append(search_documents(counted, wanted, weights, n_docs, n_terms, k, block, leaf))
    if not parts:
        schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema["item_id"].dataType),
                               T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                               T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    best = stored(reduce(DataFrame.unionByName, parts), "search-best")
    top = top_k_per_key(best, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, salt_col="doc_id")
    return top.join(asked.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")
