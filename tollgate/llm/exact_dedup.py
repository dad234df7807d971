"""Exact dedup with an extendible-hash index on shared files.

Every text, normalised by lower-casing A-Z, has a 64-bit key.  Copies are merged
on the map side, so a text that a third of all rows hold reaches the index once a
map task.

The *directory* starts with one bucket; each doubling takes one more bit of the
key, and only buckets with more than ``capacity`` entries are split by it.  It
names, for every *cell* (the top bits of a key), the bucket's depth.  The index is
a Parquet table in the shared folder, range-partitioned by (bucket, key): an owner
task holds a range of keys.  Its entries of one (bucket, key) form a chain, almost
always of one; the entries of a longer one hold their texts.

A document is looked up through the directory: its cell gives the bucket, bucket
and key give the chain.  In a chain of one it is that entry, since its own text
was entered there; in a longer one its bytes are compared with each entry's.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tollgate.llm.common import ascii_lower, stored

#: entries a bucket holds before the directory splits it
CAPACITY = 100_000


def _keyed(docs: DataFrame, key_bits: int) -> DataFrame:
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    return (docs.select("doc_id", norm.alias("norm"))
            .select("doc_id", "norm", F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits).alias("key")))


def _sha(norm: str = "norm"):
    return F.sha2(F.col(norm).cast("binary"), 256)


def directory(slots: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[int, DataFrame]:
    """Bits of a cell, and the table (cell, local_depth, bucket): the bucket of a cell is its
    first ``local_depth`` bits.  Depth d fits where the entries under the cell's
    first d bits are at most ``capacity``; the least such depth is where
    splitting stops.  Cells are eight times as many as full buckets, so the
    table follows the number of entries / capacity."""
    n = slots.count()
    bits = min(key_bits, max(1, (n // capacity).bit_length() + 3))
    cell = F.shiftrightunsigned("key", key_bits - bits) if key_bits > bits else F.col("key")
    cells = slots.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    depths = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    depths = depths.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
    fits = (depths.groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
            .where((F.col("n") <= capacity) | (F.col("depth") == bits)).select("depth", "prefix"))
    places = (depths.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
              .groupBy("cell").agg(F.min("depth").alias("local_depth")))
    bucket = F.expr(f"shiftleft(shiftrightunsigned(cell, {bits} - local_depth), {bits} - local_depth)")
    return bits, stored(places.withColumn("bucket", bucket), "dedup-directory")


def _routed(rows: DataFrame, found: tuple[int, DataFrame], key_bits: int) -> DataFrame:
    """``rows`` with the bucket that the directory names for their key."""
    bits, places = found
    cell = F.shiftrightunsigned("key", key_bits - bits) if key_bits > bits else F.col("key")
    return rows.withColumn("cell", cell).join(places, "cell").drop("cell")


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[tuple[int, DataFrame], DataFrame]:
    """The directory, and the index: one row per distinct normalised text with
    (bucket, local_depth, key, chain, links, keep_id, group_size, norm), stored in
    the shared folder and range-partitioned by bucket and key.

    ``links`` is the length of the chain; ``norm`` is the text where that is more
    than one, else null.  ``keep_id`` is the largest doc_id of the group (null only
    if all are null).  ``key_bits`` below 64 makes collisions likely (tests)."""
    keyed = _keyed(docs, key_bits)
    slots = keyed.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    slots = stored(slots.drop("norm"), "dedup-slots")
    found = directory(slots, capacity, key_bits)
    # keys of several texts: only these entries need their bytes
    shared = stored(slots.groupBy("key").agg(F.count("*").alias("links")).where("links > 1"), "dedup-shared")
    if shared.isEmpty():
        entries = slots.select("*", F.lit(1).alias("chain"), F.lit(1).cast("long").alias("links"), F.lit(None).cast("string").alias("norm"))
    else:
        single = slots.join(shared, "key", "left_anti").select(
            "*", F.lit(1).alias("chain"), F.lit(1).cast("long").alias("links"), F.lit(None).cast("string").alias("norm"))
        several = (keyed.join(shared.select("key"), "key", "left_semi").groupBy("key", "norm")
                   .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                   .withColumn("chain", F.row_number().over(W.partitionBy("key").orderBy("norm"))).join(shared, "key"))
        entries = single.unionByName(several)
    index = _routed(entries, found, key_bits)
    return found, stored(index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"), "dedup-index")


def lookup(docs: DataFrame, found: tuple[int, DataFrame], index: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size of every document, through the
    directory.  The documents must be those that the index was built of: one whose
    bucket and key hold no entry is not returned."""
    keyed = _keyed(docs, key_bits)
    names = ("doc_id", "text_sha256", "keep_id", "group_size")
    one = index.where("links = 1").select("bucket", "key", "keep_id", "group_size")
    out = _routed(keyed.select("doc_id", "key", _sha().alias("text_sha256")), found, key_bits).join(one, ["bucket", "key"]).select(*names)
    chains = index.where("links > 1").select("bucket", "key", "norm", "keep_id", "group_size")
    if not chains.isEmpty():
        several = keyed.join(chains.select("key").distinct(), "key", "left_semi")
        several = _routed(several, found, key_bits).join(chains, ["bucket", "key", "norm"])
        out = out.unionByName(several.withColumn("text_sha256", _sha()).select(*names))
    return out


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other.  Of a
    group the largest doc_id stays; a null doc_id is smaller than any other.  Of repeated
    rows (same doc_id and text) one is kept.  An empty table gives an empty
    result; other columns are ignored.  A text of any length is one value of a row:
    it is hashed and compared whole."""
    found, index = build_index(docs, capacity, key_bits)
    marks = lookup(docs, found, index, key_bits)
    again = F.row_number().over(W.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1)))
    return marks.withColumn("again", again).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps.  Documents
    to drop are taken out by an anti join on doc_id (the planner broadcasts
    them only where the stored table is small enough); rows whose doc_id
    occurs more than once are told apart by doc_id and text."""
    marks = stored(exact_dedup(docs), "dedup-marks")
    multi = stored(marks.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"),
                   "dedup-multi")
    dropped = marks.where(~F.col("kept")).select("doc_id")
    once = docs.join(multi, docs["doc_id"].eqNullSafe(multi["doc_id"]), "left_anti")
    once = once.join(dropped, once["doc_id"].eqNullSafe(dropped["doc_id"]), "left_anti")
    some = docs.join(multi, docs["doc_id"].eqNullSafe(multi["doc_id"]), "left_semi")
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    keep = marks.where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("sha"))
    some = some.withColumn("__sha", sha)
    some = some.join(keep, some["doc_id"].eqNullSafe(keep["keep"]) & (some["__sha"] == keep["sha"]), "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "__sha").orderBy(F.lit(1)))
    some = some.withColumn("__nth", nth).where("__nth = 1").drop("__sha", "__nth")
    return once.unionByName(some)
