"""The corpus pipeline: documents in, packed token sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes each result as Parquet into the shared folder and reads
it again.  All stages but the last return the columns of ``documents``.

1. toxicity: documents that the classifier, trained on the labels of the run,
   scores at 0.3 or more go.
2. exact dedup: of texts equal after lower-casing A-Z the largest doc_id stays.
3. n-gram Jaccard join: of texts that similarity 0.8 on five-word sets links up,
   the least doc_id stays.
4. benchmark decontamination: contaminated documents go.
5. best-fit packing: the rest becomes pieces of sequences of 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from tollgate.llm.common import stored, table

#: no SQL expresses a trained network, so the tests hold the run against a brute-force version
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_similar),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all filters keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
