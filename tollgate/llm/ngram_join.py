"""Similarity join on word n-grams: MinHash banding, verified on full sets.

1. Every text becomes the set of its word 5-grams.  Texts with the same set are
   one *class*; from here on a class has one representative.
2. A representative has ``bands * rows`` MinHash values; ``choose_bands`` takes
   the most rows a band for which pairs at the threshold still meet in some
   band with the target probability.
3. Representatives are shuffled on (band, hash).  A bucket is split into blocks
   of bounded size, and each pair of blocks is a task of its own: n members
   make n * (n / block) rows, never n * n.  A pair that meets in several bands
   is counted in the first of them, and a bucket whose members all meet in an
   earlier band is left out.
4. A task compares the full n-gram sets of its pairs (a matrix product counts
   all intersections) and returns, for each member, how many links it has there
   and the root of its links' component in this task: rows in proportion to the
   members, not the pairs.
5. The roots join up to groups by label propagation with pointer jumping.

Copies are never expanded into pairs; the links of a document are counted
through the sizes of the linked classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tollgate.llm.common import stored
from tollgate.llm.words import mix, ngram_hashes, word_hashes

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 96
#: members of a block, and characters of their texts
BLOCK_ROWS = 1024
BLOCK_CHARS = 8_000_000
#: a key table up to this size is sent to all tasks; a larger one is joined by shuffle
BROADCAST_BYTES = 16 * 1024 * 1024


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and with them the fewest bands, at
    which a pair of similarity ``threshold`` meets in some band with
    probability ``recall``, within ``most`` hashes.  More rows mean fewer pairs
    that meet by chance."""
    best = (0, 0)
    for rows in range(1, most + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best == (0, 0):
        raise ValueError("no banding reaches the recall within so many hashes")
    return best


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | np.uint64(1)


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The n-gram set of each text, as sorted hashes."""
    grams, counts = ngram_hashes(*word_hashes(texts), n)
    ends = np.cumsum(counts)
    return [np.unique(grams[e - c:e]) for c, e in zip(counts, ends, strict=True)]


def signatures(texts: list[bytes], n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: grams in its set, two hashes of the set, and its band hashes."""
    sets = sets_of(texts, n)
    sizes = np.array([len(s) for s in sets], np.int64)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        grams = np.concatenate([sets[i] for i in full])
        at = np.cumsum(sizes[full]) - sizes[full]
        one[full] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), at)
        two[full] = np.add.reduceat(mix(grams + np.uint64(0x14057B7EF767814F)), at)
        xors, odds = _constants(bands * rows)
        for b in range(bands):
            h = np.full(len(full), b + 1, np.uint64)
            for r in range(b * rows, b * rows + rows):
                h = mix(h + np.minimum.reduceat((grams ^ xors[r]) * odds[r], at))
            out[full, b] = h
    return sizes, one, two, out


def _signature_table(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Stored: row, doc_id, two keys and the length of the text, grams, two set hashes, bands."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                           F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # a few texts at a time in memory
                part = batch.slice(a, 512)
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                sizes, one, two, h = signatures(texts, n, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * bands, bands, dtype=np.int32)),
                                                 pa.array(h.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("row", "doc_id", "k1", "k2")]
                    + [pa.array([len(x) for x in texts], pa.int64()), pa.array(sizes),
                       pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
                    names=["row", "doc_id", "k1", "k2", "chars", "grams", "s1", "s2", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    return stored(numbered.mapInArrow(run, f"row long, doc_id {kind}, k1 long, k2 long, chars long, grams long, s1 long, "
                                           "s2 long, bands array<long>"), "signatures")


def _verify(n: int, threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, lo, hi = key[0], key[2], key[3]
        m = len(pdf)
        sets = sets_of([x.encode() for x in pdf["text"]], n)
        sizes = np.array([len(s) for s in sets], np.float64)
        owner = np.repeat(np.arange(m), [len(s) for s in sets])
        _, gram, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = freq[gram] > 1
        owner, gram = owner[shared], np.unique(gram[shared], return_inverse=True)[1]
        order = np.argsort(gram, kind="stable")
        owner, gram = owner[order], gram[order]
        common = np.zeros((m, m), np.float32)
        width = max(64, 4_000_000 // m)
        for start in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
            a, b = np.searchsorted(gram, (start, start + width))
            part = np.zeros((m, width), np.float32)
            part[owner[a:b], gram[a:b] - start] = 1
            common += part @ part.T
        link = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        h = np.stack(pdf["bands"].to_numpy())
        for k in range(band):  # pairs that have met before
            link &= h[:, k][:, None] != h[:, k][None, :]
        if lo != hi:
            side = (pdf["block"] == lo).to_numpy()
            link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, False)
        n_links = link @ pdf["size"].to_numpy(np.float64)
        rows = pdf["row"].to_numpy()
        root = np.arange(m)
        seen = np.zeros(m, bool)
        for i in np.argsort(rows):
            if seen[i] or not link[i].any():
                continue
            front = np.zeros(m, bool)
            front[i] = True
            while front.any():
                seen |= front
                root[front] = i
                front = link[front].any(axis=0) & ~seen
        some = link.any(axis=1)
        return pd.DataFrame({"row": rows[some], "root": rows[root[some]],
                             "links": n_links[some].astype(np.int64)})

    return run


def _members(reps: DataFrame) -> DataFrame:
    """(band, h, row, n, chars): members of buckets of two or more in which some pair meets first."""
    spread = reps.select("row", "chars", F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("band", "h").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars")).where("n > 1")
    inside = stored(spread.select("band", "h", "row").join(buckets, ["band", "h"]), "members")
    few = stored(inside.select("row").distinct(), "member-rows")
    bands = reps.select("row", "bands").join(few, "row")
    # a band in which the whole bucket agrees is handled there; agreement shows in equal extremes
    flat = inside.select("band", "h", "row").join(bands, "row").select(
        "band", "h", F.posexplode(F.slice("bands", F.lit(1), F.greatest(F.col("band"), F.lit(1)))).alias("k", "v"))
    same = (flat.where("k < band").groupBy("band", "h", "k").agg(F.min("v").alias("a"), F.max("v").alias("b"))
            .where("a = b").select("band", "h").distinct())
    return inside.join(same, ["band", "h"], "left_anti")


def _components(edges: DataFrame) -> DataFrame:
    """(row, label): the least row of each row's component, by label propagation
    with pointer jumping; every round is a stored table."""
    both = stored(edges.select(F.col("row").alias("a"), F.col("root").alias("b"))
                  .unionByName(edges.select(F.col("root").alias("a"), F.col("row").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("l")), "b")
        least = near.groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(least, "a").select("a", "label", F.least("label", "l").alias("to"))
        jump = labels.select(F.col("a").alias("to"), F.col("label").alias("further"))
        step = stored(step.join(jump, "to").select("a", "label", F.least("to", "further").alias("to")), "labels")
        labels = step.select("a", F.col("to").alias("label"))
        if not step.where("label != to").limit(1).count():
            return labels.withColumnRenamed("a", "row")


def similarity_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL,
                      block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: row (a number), doc_id, k1 and k2 (hashes of the
    text), grams (size of its n-gram set), n_links (other documents of
    similarity ``threshold`` or more), class_id (the least doc_id of the
    documents that links join up with it) and first (one row of the class,
    that of class_id, is marked).

    A text of fewer than n words has one n-gram; null and empty texts have
    none and no links.  Documents with the same set are linked to each other,
    also repeated rows.  An empty table gives an empty result."""
    bands, rows = choose_bands(threshold, recall)
    table = _signature_table(docs, n, bands, rows)
    full = table.where("grams > 0")
    same_set = ["s1", "s2", "grams"]
    classes = stored(full.groupBy(*same_set).agg(F.min(F.struct("doc_id", "row")).alias("r"), F.count("*").alias("size"))
                     .select(*same_set, "size", F.col("r.row").alias("rep")), "classes")
    reps = stored(table.select("row", "doc_id", "k1", "k2", "chars", "bands")
                  .join(classes.select(F.col("rep").alias("row"), "size"), "row"), "representatives")
    members = stored(_members(reps), "pending")
    needed = stored(reps.join(members.select("row").distinct(), "row", "left_semi"), "needed")
    few = needed.select("row", "doc_id", "k1", "k2", "size", "bands")
    if needed.count() * (64 + 8 * bands) <= BROADCAST_BYTES:
        few = F.broadcast(few)
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("x1"),
                        F.xxhash64(F.lit(1), "text").alias("x2"), "text")
    texts = keyed.join(few, (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2"))
                       & F.col("id").eqNullSafe(F.col("doc_id")))
    texts = texts.select("row", "text", "size", "bands").dropDuplicates(["row"])  # repeated rows meet here once
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("all_chars") / block_chars)).cast("int")
    dealt = members.withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "h", "row", "block", F.least("block", "other").alias("lo"),
                         F.greatest("block", "other").alias("hi"))
    found = stored(dealt.join(texts, "row").groupBy("band", "h", "lo", "hi")
                   .applyInPandas(_verify(n, threshold), "row long, root long, links long"), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    labels = _components(found)
    by_rep = links.join(labels, "row").select(F.col("row").alias("rep"), "links", "label")
    out = table.join(classes, same_set, "left").join(by_rep, "rep", "left")
    out = out.select("row", "doc_id", "k1", "k2", "grams",
                     (F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("label", "rep", "row").alias("label"))
    out = stored(out, "grouped")
    heads = out.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    return out.join(heads, "label").select("row", "doc_id", "k1", "k2", "grams", "n_links", "class_id",
                                           (F.col("head.row") == F.col("row")).alias("first"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those of a group after the
    first.  Rows of one doc_id and text go or stay together, but where the
    first of a group is among them, one of them stays."""
    marks = stored(similarity_groups(docs), "groups").groupBy("doc_id", "k1", "k2").agg(
        F.count_if(~F.col("first")).alias("go"), F.count_if("first").alias("stay"))
    marks = stored(marks.where("go > 0"), "similar")
    keyed = docs.withColumn("__1", F.xxhash64("text")).withColumn("__2", F.xxhash64(F.lit(1), "text"))
    on = (keyed["doc_id"].eqNullSafe(marks["doc_id"]) & (keyed["__1"] == marks["k1"]) & (keyed["__2"] == marks["k2"]))
    rest = keyed.join(marks, on, "left_anti")
    again = keyed.join(marks.where("stay > 0"), on, "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "__1", "__2").orderBy(F.lit(1)))
    again = again.withColumn("__n", nth).where(F.col("__n") <= 1).drop("__n")
    return rest.unionByName(again).drop("__1", "__2")
