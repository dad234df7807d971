r"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` reads every training text once and stores the postings (row,
term, position) of all terms that some benchmark item holds; no other term can
be asked for.  The segments stay where they were written, so nothing is
shuffled.  A posting of the reserved term ``END_TERM`` closes each text and
holds its number of words.

A search takes, of each window of ``WINDOW`` consecutive item words, the
rarest terms of the corpus.  The postings of the rarest give candidates
(row, diagonal), the diagonal being the text position of the item's first
word; the lists of the next ones, adjusted by their offsets in the item, are
intersected with them.  What remains is matched with the postings of all
further words of the item, and runs of matched words as long as a window are
the exact phrases.  ``proximity_matches`` asks instead that the rarest terms
stand near each other, in any order.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  Only
DataFrame functions run here.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tollgate.llm.common import SEPARATORS, ascii_lower, stored

WINDOW = 13
#: terms of a window whose lists are intersected before its other words are looked at
RAREST = 3
#: a set of benchmark terms up to this size is sent to all tasks; a larger one is joined by shuffle
BROADCAST_BYTES = 16 * 1024 * 1024
END_TERM = -1
_SEPARATOR_CHARS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


class Index(NamedTuple):
    postings: DataFrame  # row, term, pos; and doc_id, text_key in END_TERM postings
    items: DataFrame     # item, item_id, j, term, n_words: a row per word of an item


def words(text: Column) -> Column:
    """The words of a lower-cased text, in order (null and empty: none)."""
    inner = F.btrim(text, F.lit(_SEPARATOR_CHARS))
    return F.when(inner.isNull() | (inner == ""), F.array().cast("array<string>")).otherwise(
        F.split(inner, SEPARATORS))


def _small(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a broadcast hint if its rows, measured, stay under the bound."""
    size = df.agg(F.sum(F.octet_length(text) + 64).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def build_index(docs: DataFrame, benchmark: DataFrame) -> Index:
    """Postings of all benchmark terms in ``docs`` (doc_id, text) and the items
    (item_id, text) in terms.  Rows are numbered, so repeated and null doc_ids
    or item_ids do no harm; null and empty texts have no words."""
    item_words = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id",
                                  words(ascii_lower(F.col("text"))).alias("w"))
    item_words = stored(item_words.select("item", "item_id", F.size("w").alias("n_words"),
                                          F.posexplode("w").alias("j", "word")), "bench-words")
    terms = item_words.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term"))
    terms = terms.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("word"),
                                                                F.lit(END_TERM).cast("long").alias("term")))
    terms = stored(terms, "bench-terms")
    items = stored(item_words.join(terms, "word").drop("word"), "bench-items")
    text_words = words(ascii_lower(F.col("text")))
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        F.xxhash64("text").alias("text_key"),
                        F.concat(text_words, F.array(F.lit(""))).alias("w"))
    found = found.select("row", "doc_id", "text_key", F.posexplode("w").alias("pos", "word"))
    last = F.col("term") == END_TERM
    postings = (found.join(_small(terms, "word"), "word")
                .select("row", "term", "pos", F.when(last, F.col("doc_id")).alias("doc_id"),
                        F.when(last, F.col("text_key")).alias("text_key")))
    return Index(stored(postings, "postings"), items)


def _rarest(index: Index, window: int, rarest: int) -> DataFrame:
    """(item, term1, j1, term2, j2, ...): the rarest terms, by postings, of
    every window of every item, without repeats and without windows that hold
    a term the corpus lacks.  A window of fewer words repeats its rarest."""
    counts = index.postings.where(F.col("term") != END_TERM).groupBy("term").agg(F.count("*").alias("n"))
    words_ = index.items.join(counts, "term", "left").fillna(0, ["n"])
    per_item = words_.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("j", "term", "n"))).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - F.lit(window), F.lit(0)))
    out = per_item.select("item", "w", F.explode(starts).alias("s"))
    part = F.slice("w", F.col("s") + 1, F.lit(window))
    ranked = F.sort_array(F.transform(part, lambda x: F.struct(x["n"].alias("n"), x["j"].alias("j"),
                                                               x["term"].alias("term"))))
    out = out.select("item", ranked.alias("r")).where(F.col("r")[0]["n"] > 0)
    picks = []
    for k in range(rarest):
        at = F.when(F.size("r") > k, F.get("r", F.lit(k))).otherwise(F.get("r", F.lit(0)))
        picks += [at["term"].alias(f"term{k}"), at["j"].alias(f"j{k}")]
    return out.select("item", *picks).distinct()


def _rare_postings(index: Index, keys: DataFrame, rarest: int) -> DataFrame:
    """Postings of the terms that ``keys`` (of ``_rarest``) names."""
    named = keys.select(F.explode(F.array(*[f"term{k}" for k in range(rarest)])).alias("term")).distinct()
    small = index.items.select("term").distinct().count() * 16 <= BROADCAST_BYTES
    return index.postings.select("row", "term", "pos").join(F.broadcast(named) if small else named, "term")


def phrase_hits(index: Index, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(row, item, item_id, positions): the text positions of words inside an
    occurrence of a window of the item, a row per diagonal of an item in a
    text.  An item of fewer words than ``window`` is one window."""
    keys = stored(_rarest(index, window, rarest), "rarest")
    rare = stored(_rare_postings(index, keys, rarest), "rare-postings")
    found = (keys.join(rare.withColumnRenamed("term", "term0"), "term0")
             .withColumn("diag", F.col("pos") - F.col("j0")).drop("pos"))
    for k in range(1, rarest):
        found = (found.withColumn(f"at{k}", F.col("diag") + F.col(f"j{k}"))
                 .join(rare.select("row", F.col("term").alias(f"term{k}"), F.col("pos").alias(f"at{k}")),
                       ["row", f"term{k}", f"at{k}"]))
    found = stored(found.select("row", "item", "diag").distinct(), "diagonals")
    rows = stored(found.select("row").distinct(), "rows")
    there = index.postings.select("row", "term", "pos").join(rows, "row", "left_semi")
    needed = found.join(index.items, "item").withColumn("pos", F.col("diag") + F.col("j"))
    runs = (needed.join(there, ["row", "term", "pos"])
            .groupBy("row", "item", "item_id", "diag", "n_words").agg(F.sort_array(F.collect_list("j")).alias("js"))
            .withColumn("span", F.least("n_words", F.lit(window))))
    # the i-th matched word opens a window if the (i + span - 1)-th stands span - 1 words on
    opens = F.filter("js", lambda x, i: F.get("js", i + F.col("span") - 1) == x + F.col("span") - 1)
    runs = runs.withColumn("opens", opens).where(F.size("opens") > 0)
    hit = F.array_distinct(F.flatten(F.transform("opens", lambda x: F.sequence(
        F.col("diag") + x, F.col("diag") + x + F.col("span") - 1))))
    return runs.select("row", "item", "item_id", hit.alias("positions"))


def proximity_matches(index: Index, slop: int = 5, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(row, item, item_id, span): texts in which the rarest terms of some
    window of an item stand, in any order, within ``window + slop`` words; span
    is the fewest words that hold them.  Every exact phrase is among them."""
    keys = stored(_rarest(index, window, rarest), "rarest")
    rare = stored(_rare_postings(index, keys, rarest), "rare-postings")
    most = window + slop - 1
    found = keys.join(rare.withColumnRenamed("term", "term0"), "term0").withColumn("lo", F.col("pos"))
    found = found.withColumnRenamed("pos", "hi")
    for k in range(1, rarest):
        other = rare.select("row", F.col("term").alias(f"term{k}"), F.col("pos").alias("p"))
        found = (found.join(other, ["row", f"term{k}"])
                 .withColumn("lo", F.least("lo", "p")).withColumn("hi", F.greatest("hi", "p")).drop("p")
                 .where(F.col("hi") - F.col("lo") <= most))
    ids = index.items.select("item", "item_id").distinct()
    return (found.groupBy("row", "item").agg((F.min(F.col("hi") - F.col("lo")) + 1).alias("span"))
            .join(ids, "item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """One row per document: doc_id, text_key (hash of the text), n_words,
    n_hit, n_items, items_sha256 and contaminated (a hit word, and hit words a
    twentieth of all or more).

    items_sha256 is of the distinct item_ids as strings, sorted and
    comma-joined; null item_ids are left out of it and of n_items.  A null or
    empty text, an empty table on either side, gives no hits."""
    index = build_index(docs, benchmark)
    hits = phrase_hits(index, window, rarest)
    per_doc = hits.groupBy("row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ends = index.postings.where(F.col("term") == END_TERM).select("row", "doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    out = ends.join(per_doc, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__id"),
                                                                      F.col("text_key").alias("__key")).distinct()
    bad = stored(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"]),
                     "left_anti")
