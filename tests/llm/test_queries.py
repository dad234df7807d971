"""The registered queries with a DuckDB statement, held against it."""

import pytest
from oracle_compare import compare, duck

from tollgate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query_with_a_doc():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert all(f.__doc__ for f in QUERIES.values()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert r["ok"], r


def test_op8_is_a_whole_placement(spark):
    import zlib

    import duckdb
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)


def test_native_operators_run_no_python(spark):
    for name in ("op2_decontaminate", "op4_chat_format", "op7_exact_dedup"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name
