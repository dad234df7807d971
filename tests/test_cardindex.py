"""The card index: right rows, and fewer row groups read than there are."""

import glob

import pyarrow.parquet as pq
import pytest
from conftest import SF_MID, SF_SMALL
from oracle_compare import compare, duck
from pyspark.sql import functions as F

from tollgate.operators import cardindex as X
from tollgate.operators import lookups as L
from tollgate.plans import ORACLES, QUERIES
from tollgate.sources import fixtures as fx


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def scanned(df) -> int:
    """Rows that the scan of the executed plan read."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        node, todo = None, [plan]
        while todo:
            x = todo.pop()
            if "FileSourceScan" in x.getClass().getSimpleName():
                node = x
            todo += [x.children().apply(i) for i in range(x.children().size())]
        return node.metrics().apply("numOutputRows").value()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cards") / "index")
    users = fx.users(spark, SF_MID).unionByName(spark.range(200_000, 260_000).select(
        F.col("id").alias("userid"), F.format_string('{"loyaltySchemeNumber":%d}', F.col("id")).alias("user_json_object"),
        F.timestamp_micros(F.lit(fx.BASE_US)).alias("user_last_seen"),
        F.lit(None).cast("long").alias("user_softlock_sessionid"),
        F.lit(None).cast("timestamp").alias("user_softlock_expiry")))
    return users, X.write_card_index(users, path, rows_per_file=8_000, row_group=64 << 10), path


def test_query_matches_oracle(spark):
    r = compare(QUERIES["find_by_card_index"](spark, SF_SMALL), duck(SF_SMALL), ORACLES["find_by_card_index"])
    assert r["ok"], r


def test_layout_has_several_row_groups_with_bloom_filters(index):
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(index[2] + "/*.parquet")]
    assert sum(m.num_row_groups for m in groups) >= 8
    for m in groups:
        lo_hi = [m.row_group(i).column(m.schema.names.index("card")).statistics for i in range(m.num_row_groups)]
        assert all(a.max <= b.min for a, b in zip(lo_hi, lo_hi[1:], strict=False))


@pytest.mark.parametrize("cards", [200_500, "259999", [200_500, 230_000, None], []])
def test_point_lookup_reads_few_rows(index, cards):
    users, idx, _ = index
    want = L.find_by_loyalty_card(users, [c for c in cards if c is not None] if isinstance(cards, list) else cards)
    assert _rows(X.lookup_cards(idx, cards)) == _rows(want)
    if cards != []:
        assert 0 < scanned(X.lookup_cards(idx, cards)) < idx.count() / 3


def test_an_absent_card_in_range_reads_nothing_by_its_bloom_filter(index):
    idx = index[1]
    assert X.lookup_cards(idx, "2005x").count() == 0
    assert scanned(X.lookup_cards(idx, "2005x")) < idx.count() / 10


def test_bulk_lookup_prunes_and_joins_beyond_the_bound(spark, index, monkeypatch):
    users, idx, _ = index
    probes = spark.createDataFrame([(i, 200_000 + 7 * i) for i in range(40)] + [(90, None), (91, 200_007), (92, -5)],
                                   "probe_id long, card long")
    want = _rows(L.find_by_loyalty_card(users, probes))
    few = X.lookup_cards(idx, probes)
    assert _rows(few) == want and len(want) == 41
    monkeypatch.setattr(X, "PROBED", 10)
    assert _rows(X.lookup_cards(idx, probes)) == want                       # a join
    many = [200_000 + 7 * i for i in range(40)]
    assert X.lookup_cards(idx, many).count() == 40


def test_in_lists_are_split_into_neighbours(index):
    """Cards at both ends: one long IN would be pushed down as the whole range."""
    idx = index[1]
    cards = [200_000 + i for i in range(9)] + [259_980 + i for i in range(9)]
    assert X.lookup_cards(idx, cards).count() == 18
    assert scanned(X.lookup_cards(idx, cards)) < idx.count() / 2


def test_empty_users_and_users_without_a_card(spark, tmp_path):
    users = spark.createDataFrame([(1, None), (2, "{}"), (3, "no json"), (None, '{"loyaltySchemeNumber":5}')],
                                  "userid long, user_json_object string")
    idx = X.write_card_index(users, str(tmp_path / "a"))
    assert idx.count() == 4 and [r.userid for r in X.lookup_cards(idx, 5).collect()] == [None]
    assert X.lookup_cards(X.write_card_index(users.limit(0), str(tmp_path / "b")), 5).count() == 0
