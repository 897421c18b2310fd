"""Plans, not results: what is scanned, what moves, and what must never appear."""

from __future__ import annotations

import os

import pytest

from keyvigil.plans.catalog import QUERIES, Context
from keyvigil.session import discard_written, written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["c2_outcomes", "c9_keys_out_of_reach", "d5_profiles", "d13_metrics", "d28_business_day_counts", "h3_rule_alerts"]
)
def test_no_pairs_are_formed(spark, name):
    plan = _plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bounded_keys_do_not_move_the_log(spark):
    plan = _plan(QUERIES["c2_outcomes"](spark, FOLDER))
    assert "user_id" in plan
    log_scan = next(line for line in plan.splitlines() if "FileScan" in line and "event_id" in line)
    assert "value" not in log_scan.split("ReadSchema")[1] and "event_type" not in log_scan.split("ReadSchema")[1]


def test_unbounded_sides_are_left_to_the_planner(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        context = Context(spark, FOLDER)
        plan = _plan(context.log)
        # Both sides meet the log in shuffle joins, which the adaptive planner can split.
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        expected = sorted(context.log.select("event_id", "outcome").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert expected == sorted(QUERIES["c2_outcomes"](spark, FOLDER).collect())


def test_phase_filter_reaches_the_scan(spark):
    plan = _plan(QUERIES["c5_labels"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-15T00:00), LessThan(ts,2024-01-29T00:00)]" in plan


def test_stored_tables_can_be_discarded(spark):
    table = written(spark.range(10).withColumnRenamed("id", "n"), "probe")
    assert table.count() == 10
    assert discard_written(spark) >= 1
    assert discard_written(spark) == 0
