"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
# One or two of each family; the driver compares all of them on the larger tables.
SAMPLE = (
    "a8_missing_runs", "b7_filter_expression", "c2_outcomes", "c9_keys_out_of_reach", "d3_sessions", "d5_profiles",
    "d7_thresholds", "d13_metrics", "d26_threshold_histogram", "d31_sessions_per_day", "e3_holdout", "e6_injected_sessions",
    "e9_roc_curve", "e10_stump", "e13_sample_quotas", "g4_gaps_expected", "h3_rule_alerts", "h12_rule_importance",
    "h14_comparison", "s3_streaming_alerts", "a1_operators_both_layouts", "a2_one_run", "a4_runs_written_again", "b4_columns", "b5_guards",
    "c1_audit_log", "c3_unknown_operators", "c9_scopes_out_of_reach", "d28_business_day_counts", "d32_operation_mix", "e3_grid_holdout",
    "e11_signed_rank", "f5_operators_of_both_phases", "f6_keys_not_evaluated", "g4_daily_counts_expected", "g5_address_usage",
    "g5_unseen_addresses", "h1_cells_add_up", "h3_grid_alerts", "d33_regime_overview", "d42_request_period",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    corpus = {name for name in contract.queries() if name.startswith("op") or name == "pipeline"}
    without = set(contract.queries()) - set(contract.oracle_sql()) - corpus
    assert without == {
        "h4_random_forest", "h5_boosted_trees", "h8_search", "h10_models", "h10_chosen_models", "h12_forest_importance",
        "h12_model_importance", "h14_model_comparison",
    }


def test_entry_is_the_flagship(spark):
    found = contract.entry(spark)
    assert found.count() == 102 and {"rules_fired", "predicted", "compromised"} <= set(found.columns)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, database, name):
    frame = contract.queries()[name](spark, FOLDER)
    answer = database.execute(contract.oracle_sql()[name])
    expected = _table([column[0] for column in answer.description], answer.fetchall())
    assert _table(frame.columns, [tuple(row) for row in frame.collect()]) == expected
