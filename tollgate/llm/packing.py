"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

A text becomes ids and a closing id 0; texts longer than a sequence are cut
into full pieces and a rest.  Pieces of one length are interchangeable, and so
are sequences with one gap, so a round works on *runs*: (length, first rank,
count) of pieces still to place and (gap, first sequence, count) of sequences.

A round range-sorts pieces and gaps together by size; every task sweeps its
range from the longest piece down and gives it the successor, the smallest gap
that holds it.  Where many pieces of a length want one gap, the lower ranks
take it and the others go on to the next.  What is left of a gap is a gap again
in this range, and is range-sorted anew for the next round.  The ranges get
wider from round to round until one range holds all; when then nothing fits any
more, as many sequences are opened as the rest needs at least, until every
piece is placed.  Runs are
bounded by lengths and rounds, not by documents; the documents themselves only
meet their placements in one last join.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tollgate.llm.common import stored
from tollgate.llm.tokens import encoder

LENGTH = 2048
#: range partitions of the first rounds; then one
RANGES = (8, 2)
#: ranks that meet their placements in one join key
BLOCK = 4096
_RUNS = "kind int, size long, first long, n long, seq long, gap long"
PIECE, GAP, PLACED = 0, 1, 2


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """Stored: row, doc_id, piece, start, length, ids_crc32 of every document's
    pieces.  A null text is empty; an empty text is the closing id alone."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                at_row, piece, start, size, crc = [], [], [], [], []
                for i, ids in enumerate(enc.encode([x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()])):
                    ids += b"\0\0\0\0"
                    for k, s in enumerate(range(0, len(ids), 4 * length)):
                        cut = ids[s:s + 4 * length]
                        at_row.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        size.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                which = pa.array(at_row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(which), part.column("doc_id").take(which), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return stored(numbered.mapInArrow(run, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"),
                  "pieces")


def _ranked(cut: DataFrame, rows_per_run: int = 250_000) -> DataFrame:
    """``cut`` with rank, gapless from 0 among the pieces of a length; a length
    is numbered in runs, so none is sorted in one task."""
    runs = max(1, math.ceil(cut.count() / rows_per_run))
    cut = cut.withColumn("run", F.pmod(F.xxhash64("row", "piece"), F.lit(runs)))
    starts = cut.groupBy("length", "run").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("length", "run").orderBy("row", "piece"))
    return (cut.withColumn("nth", nth).join(starts, ["length", "run"])
            .withColumn("rank", F.col("before") + F.col("nth") - 1).drop("run", "nth", "before"))


def sweep(runs: list[tuple]) -> list[tuple]:
    """One successor sweep over (kind, size, first, n, seq, gap) runs of one
    range: pieces from the longest down, each to the smallest gap that holds
    it, whose rest is a gap again.  Placed runs come back as such, with the gap
    they met; then what is left of pieces and gaps."""
    todo = sorted((r for r in runs if r[0] == PIECE), key=lambda r: (-r[1], r[2]))
    gaps = sorted((r[1], r[2], r[3]) for r in runs if r[0] == GAP)
    out = []
    for _, size, first, n, _, _ in todo:
        while n:
            at = bisect_left(gaps, (size, -1, -1))
            if at == len(gaps):
                out.append((PIECE, size, first, n, -1, -1))
                break
            gap, seq, free = gaps.pop(at)
            take = min(n, free)
            out.append((PLACED, size, first, take, seq, gap))
            if gap > size:
                insort(gaps, (gap - size, seq, take))
            if free > take:
                insort(gaps, (gap, seq + take, free - take))
            first += take
            n -= take
    return out + [(GAP, gap, seq, n, -1, -1) for gap, seq, n in gaps]


def _sweep_range(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs = [r for pdf in parts for r in pdf.itertuples(index=False, name=None)]
    yield pd.DataFrame(sweep(runs), columns=["kind", "size", "first", "n", "seq", "gap"])


def plan(counts: DataFrame, length: int = LENGTH, ranges: tuple[int, ...] = RANGES) -> DataFrame:
    """Placements (length, first, n, seq, gap) for pieces counted by length
    (columns length, n): ranks first .. first + n - 1 of a length go to
    sequences seq .. seq + n - 1, each behind ``LENGTH - gap`` ids."""
    spark = counts.sparkSession
    # an empty part keeps the schema where there is nothing to pack
    state = stored(counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"),
                                 F.col("n").cast("long").alias("n"), F.lit(-1).cast("long").alias("seq"),
                                 F.lit(-1).cast("long").alias("gap")).coalesce(1), "runs")
    placed, opened, step = [], 0, 0
    while True:
        left = state.where(F.col("kind") == PIECE).agg(F.sum(F.col("n") * F.col("size")).alias("ids"),
                                                       F.min("size").alias("least"),
                                                       F.sum("n").alias("n")).first()
        if not left["n"]:
            break
        if step == 0 or (step > len(ranges) and left["n"] == before):
            more = -(-left["ids"] // length)
            fresh = spark.range(1).select(F.lit(GAP).alias("kind"), F.lit(length).cast("long").alias("size"),
                                          F.lit(opened).cast("long").alias("first"), F.lit(more).cast("long").alias("n"),
                                          F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("gap"))
            opened += more
            state = state.unionByName(fresh)
        before = left["n"]
        # gaps that no piece fits any more are done
        live = state.where((F.col("kind") == PIECE) | (F.col("size") >= left["least"]))
        live = live.repartitionByRange(ranges[step], "size") if step < len(ranges) else live.coalesce(1)
        done = stored(live.mapInPandas(_sweep_range, _RUNS), "runs")
        placed.append(done.where(F.col("kind") == PLACED))
        state = done.where(F.col("kind") != PLACED)
        step += 1
    out = state.where(F.lit(False))
    for x in placed:
        out = out.unionByName(x)
    return out.select(F.col("size").alias("length"), "first", "n", "seq", "gap")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: row, doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.  Repeated rows are packed as often as they occur;
    null doc_ids are packed like others; an empty table gives an empty result."""
    cut = pieces(docs, length, vocabulary)
    placed = stored(plan(cut.groupBy("length").agg(F.count("*").alias("n")), length), "placements")
    last = F.col("first") + F.col("n") - 1
    keyed = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))))
    ranked = _ranked(cut).withColumn("block", F.floor(F.col("rank") / BLOCK))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    out = ranked.join(keyed, ["length", "block"]).where(inside)
    return out.select("row", "doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("seq") + F.col("rank") - F.col("first")).alias("sequence_id"),
                      (F.lit(length) - F.col("gap")).cast("long").alias("offset"))
