"""Card index (F2): users laid out by the card number inside their JSON.

The card is extracted once and stored as a column.  The index is range-
partitioned and sorted by it, so the minima and maxima of the Parquet row
groups lie side by side, and each row group has a bloom filter for cards
within its range that it does not hold.  A lookup is a filter that the scan
pushes down: it reads the row groups that may hold the card.

Some cards are looked up as ranges of neighbours.  A table of probes is
counted first: up to ``PROBED`` different cards become such a filter, more are
joined, where Spark reads the whole index once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.columns import loyalty_number_text

#: rows of one index file, bytes of a row group
ROWS_PER_FILE, ROW_GROUP = 5_000_000, 32 << 20
#: different cards a filter holds, and those of one pushed-down IN
PROBED, PER_IN = 1_000, 10


def write_card_index(users: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE,
                     row_group: int = ROW_GROUP) -> DataFrame:
    """Write the index of ``users``, all columns and ``card``, and read it back.
    Users without a card are in it under NULL, which no lookup meets.  Users
    that share a card are sorted by id as well, so a card that many hold fills
    several files.  ``rows_per_file`` sets how many files there are, with the
    number of users."""
    files = max(1, math.ceil(users.count() / rows_per_file))
    keyed = users.withColumn("card", loyalty_number_text("user_json_object"))
    (keyed.repartitionByRange(files, "card", "userid").sortWithinPartitions("card", "userid")
     .write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#card", "true")
     .option("parquet.block.size", row_group)
     .parquet(path))
    return open_card_index(users.sparkSession, path, keyed.schema)


def open_card_index(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def any_of(cards: Iterable, column: str = "card") -> Column:
    """``column`` is one of the cards, as alternatives of at most PER_IN
    neighbours.  A longer IN is pushed down as one range from its least to its
    greatest value, which prunes nothing between them."""
    known = sorted({str(c) for c in cards if c is not None})
    out = F.lit(False)
    for at in range(0, len(known), PER_IN):
        part = F.col(column).isin(known[at:at + PER_IN])
        out = part if at == 0 else out | part
    return out


def lookup_cards(index: DataFrame, cards) -> DataFrame:
    """Users by card.  ``cards`` is a number, a list of any length, or a DataFrame
    (probe_id, card), which gives (probe_id, user columns): one row per probe
    and user.  A NULL card finds nothing."""
    if not isinstance(cards, DataFrame):
        some = [cards] if isinstance(cards, (str, int)) else list(cards)
        if len(some) > PROBED:
            spark = index.sparkSession
            probes = spark.createDataFrame([(str(c),) for c in set(some) if c is not None], "card string")
            return index.join(probes, "card", "left_semi").drop("card")
        return index.filter(any_of(some)).drop("card")
    probe_id, card = cards.columns[:2]
    probes = cards.select(F.col(probe_id).alias("probe_id"), F.col(card).cast("string").alias("card"))
    few = probes.select("card").filter(F.col("card").isNotNull()).distinct().limit(PROBED + 1).collect()
    if len(few) <= PROBED:
        index = index.filter(any_of(r["card"] for r in few))
    return probes.join(index, "card").drop("card")
