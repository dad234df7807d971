"""Sharding by a hierarchical weighted hash tree.

The tree has three levels: regions, racks, shards.  A document descends it: on
each level every child draws, and the largest draw wins.  A shard draws
``ln(u) / weight`` from a hash of (doc_id, shard); a rack or region draws the
largest draw of the shards below it, which is distributed as one draw with the
sum of their weights.  A child is therefore chosen in proportion to its weight,
and the draw of a subtree changes only where a weight inside it does: documents
move into subtrees that gained weight or out of those that lost it, and stay on
their way everywhere else.  One more shard, wherever it stands, takes documents
only into itself.

``tree(n)`` fills whole regions one after the other.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tollgate.llm.common import stored

SHARDS_PER_RACK = 2
RACKS_PER_REGION = 2


class Node(NamedTuple):
    name: str
    weight: float
    children: tuple  # of Node; a leaf has none and its name ends in the shard number
    shard: int = -1


def tree(shards: int, weights: dict[int, float] | None = None,
         per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> Node:
    """Shards 0..n-1 (weight 1 unless given) in racks of ``per_rack`` and
    regions of ``racks`` racks.  A shard of weight 0 receives nothing."""
    w = weights or {}

    def inner(name: str, children: list[Node]) -> Node:
        return Node(name, sum(c.weight for c in children), tuple(children))

    per_region = per_rack * racks
    regions = []
    for r in range(math.ceil(shards / per_region)):
        inside = range(r * per_region, min(shards, (r + 1) * per_region))
        rack_of: dict[int, list[Node]] = {}
        for i in inside:
            rack_of.setdefault((i - r * per_region) // per_rack, []).append(
                Node(f"shard{i}", float(w.get(i, 1.0)), (), i))
        regions.append(inner(f"region{r}", [inner(f"region{r}/rack{k}", v) for k, v in rack_of.items()]))
    return inner("root", regions)


def _draw(key: Column, node: Node) -> Column:
    """The draw of a subtree: the largest of its shards'."""
    if node.children:
        draws = [_draw(key, c) for c in node.children if c.weight > 0]
        return draws[0] if len(draws) == 1 else F.greatest(*draws)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11) + F.lit(1)) / F.lit(float(2 ** 53 + 1))
    return F.log(u) / F.lit(node.weight)


def place(key: Column, root: Node) -> Column:
    """The shard of a key: one weighted draw a level.  Equal draws of two
    children go to the first."""
    live = [c for c in root.children if c.weight > 0]
    if not root.children:
        return F.lit(root.shard)
    if not live:
        raise ValueError(f"{root.name}: no child has weight")
    if len(live) == 1:
        return place(key, live[0])
    draws = [_draw(key, c) for c in live]
    best = F.greatest(*draws)
    out = F.when(draws[0] == best, place(key, live[0]))
    for d, c in zip(draws[1:], live[1:], strict=True):
        out = out.when(d == best, place(key, c))
    return out


def shard(docs: DataFrame, root: Node, grown: Node | None = None, rows_per_run: int = 250_000) -> DataFrame:
    """Columns doc_id, size, text_crc32, shard, slot and grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1.  The doc_id alone
    decides, so repeated rows lie together; a null doc_id is a key of its own.
    slot: gapless from 0 within the shard; each shard is numbered in runs of
    about ``rows_per_run`` rows by a second hash, and a run starts where the runs
    before it end, so no task sorts a whole shard.  Very long texts are only
    measured and summed up, columns of clashing names are ignored, and an empty
    table gives an empty result."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"),
                      place(key, root).cast("int").alias("shard"),
                      (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    out = stored(out, "shard-rows")
    runs = max(1, math.ceil(out.count() / rows_per_run))
    # the row's own digest deals repeated doc_ids out as well
    out = out.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)))
    starts = out.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32"))
    return (out.withColumn("nth", nth).join(starts, ["shard", "run"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"))
