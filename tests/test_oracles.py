"""Every registered query against its DuckDB oracle (the driver's gate), at
sf0.001 so the suite stays quick; tests/run_oracles.py runs the same at
sf0.01."""

import pytest
from conftest import SF_SMALL
from oracle_compare import compare, duck

import __spark_entry__ as E
from tollgate.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


SURVEY_OPS = """
src_users src_addcredit_csv sink_financial_events tail_financial_events topic_retention src_run_logs
user_by_id find_by_loyalty_card show_transactions user_txn_ids user_sessions_of unknown_user_requests
duplicate_requests loyalty_delta_update minute_trunc date_shift null_default
current_locks user_balance allocated_credit user_allocated users_sessions recent_activity_out recent_activity_in
cluster_activity_by_users cluster_activity last_cluster_activity cluster_users user_id_range
multi_session_ref multi_session_users oldest_txn_per_user two_oldest_stale_txns
ttl_usage ttl_txns prune_two prune_oldest delete_users unlock_all
charge report_quota_usage report_usage_single_session add_credit upsert_user lock_user update_locked_user
user_360 charge_stream
current_metrics credit_flow_per_minute calls_per_minute user_lock_gauges allocated_series procedure_rate
spendable_balance negative_balance_audit missing_balance_audit topup_candidates status_mix lock_contention
latency_histogram latency_summary latency_percentiles histogram_subtract bucket_first_comment size_histogram counters
parse_run_summary sweep_verdict sla_limit fleet_total""".split()


def test_every_survey_operator_is_registered_with_a_doc():
    missing = [n for n in SURVEY_OPS if n not in QUERIES]
    assert not missing, missing
    for name, fn in QUERIES.items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"op", "status", "how_many", "unexpected"}
