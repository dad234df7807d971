import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: names that operators use inside
CLASHING = ("row", "score", "key", "bucket", "norm", "term", "pos", "item", "size", "label", "rank", "run", "shard",
            "length", "band", "h", "rep", "class_id", "found", "text_key", "kept", "n_words", "block", "layout")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) pairs; with extra columns of clashing names if asked for."""
    def make(rows, clash=False):
        df = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], SCHEMA)
        return df.withColumns({c: F.lit(7) for c in CLASHING}) if clash else df
    return make


def words(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="session")
def words_of():
    return words
