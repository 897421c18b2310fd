"""Files: round trips, missing tables, partition pruning, filters."""

from __future__ import annotations

from datetime import datetime

import pytest
from keyvigil import session
from keyvigil.schemas import OPERATORS, THRESHOLDS, WARMUP_SESSIONS
from keyvigil.sources import tables


@pytest.mark.parametrize("layout", ["parquet", "csv"])
def test_round_trip_keeps_lists_and_times(spark, tmp_path, layout):
    operators = spark.createDataFrame([("o1", "end_user", ["a", "b"], "routine", ["10.0.0.1"])], OPERATORS)
    sessions = spark.createDataFrame(
        [("s1", "o1", datetime(2026, 1, 5, 9, 0, 1), 3, 1.5, 2.0, 1, 0.0, 0.0, 0, 1)], WARMUP_SESSIONS
    )
    tables.write_table(operators, str(tmp_path), "operators", layout)
    tables.write_table(sessions, str(tmp_path), "warmup_sessions", layout)
    found = tables.read_all(spark, str(tmp_path), ["operators", "warmup_sessions"], layout)
    assert found["operators"].collect() == operators.collect()
    assert found["warmup_sessions"].collect() == sessions.collect()


def test_csv_has_a_header_and_joined_cells(spark, tmp_path):
    operators = spark.createDataFrame([("o1", "end_user", ["a", "b"], "routine", ["10.0.0.1"])], OPERATORS)
    path = tables.write_table(operators.coalesce(1), str(tmp_path), "operators", "csv")
    lines = [row.value for row in spark.read.text(path).collect()]
    assert lines == ["operator_id,profile,scopes,regime,usual_ips", "o1,end_user,a|b,routine,10.0.0.1"]


def test_missing_tables_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="thresholds"):
        tables.read_table(spark, str(tmp_path), "thresholds")
    with pytest.raises(FileNotFoundError, match="keys, operators"):
        tables.read_all(spark, str(tmp_path), ["keys", "operators"])


def test_one_run_reads_one_folder(spark, tmp_path):
    rows = [(name, 1.0, 99, 10, seed, sigma) for seed in (1, 2, 3) for sigma in (0.0, 0.5) for name in ("events", "minutes")]
    schema = "attribute string, threshold double, percentile int, sessions bigint, seed int, sigma double"
    tables.write_table(spark.createDataFrame(rows, schema), str(tmp_path), "thresholds", partitioned_by=tables.GRID)
    read = tables.read_table(spark, str(tmp_path), "thresholds", partitioned_by=tables.GRID)
    assert read.columns == [*THRESHOLDS.names, "seed", "sigma"]
    run = tables.of_run(read, 2, 0.5)
    assert run.count() == 2
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seed" in plan and "(sigma" in plan


def test_a_run_killed_half_way_is_missing_and_written_again(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path), "n bigint, seed int, sigma double"
    assert tables.uncommitted_runs(spark, root, "counts", [1], [0.0, 0.5]).count() == 2
    rows = spark.createDataFrame([(n, seed, sigma) for n in (1, 2) for seed in (1, 2) for sigma in (0.0, 0.5)], schema)
    path = tables.write_runs(rows, root, "counts")
    assert tables.uncommitted_runs(spark, root, "counts", [1, 2], [0.0, 0.5]).count() == 0

    def killed(*args, **kwargs):
        raise RuntimeError("lost")

    again = spark.createDataFrame([(7, 2, 0.5)], schema)
    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_table", killed)
        with pytest.raises(RuntimeError, match="lost"):
            tables.write_runs(again, root, "counts")
    assert [tuple(r) for r in tables.uncommitted_runs(spark, root, "counts", [1, 2], [0.0, 0.5]).collect()] == [(2, 0.5)]
    tables.write_runs(again, root, "counts")
    assert tables.uncommitted_runs(spark, root, "counts", [1, 2], [0.0, 0.5]).count() == 0
    assert {tuple(r) for r in tables.committed_runs(spark, root, "counts").collect()} == {
        (1, 0.0, 1), (1, 0.5, 1), (2, 0.0, 1), (2, 0.5, 3)
    }
    read = spark.read.schema(schema).parquet(path)
    left = sorted(tuple(r) for r in rows.where("seed <> 2 or sigma <> 0.5").collect())
    assert sorted(tuple(r) for r in read.collect()) == sorted([*left, (7, 2, 0.5)])


def test_missing_runs(spark):
    present = spark.createDataFrame([(1, 0.0), (1, 0.5), (2, 0.0)], "seed bigint, sigma double")
    assert [tuple(row) for row in tables.missing_runs(present, [1, 2], [0.0, 0.5]).collect()] == [(2, 0.5)]


def test_thresholds_of_absent_seeds(spark):
    table = spark.createDataFrame([(1, "events", 2.0)], "seed int, attribute string, threshold double")
    assert tables.thresholds_of_seeds(table, [1, 9]).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.thresholds_of_seeds(table, [9])


def test_wrong_filter_is_a_warning(spark):
    table = spark.createDataFrame([("o1", 1), ("o1", 5), ("o2", 9)], "operator_id string, events int")
    kept, warning = tables.filtered(table, "o1", "events > 2")
    assert (kept.count(), warning) == (1, None)
    for wrong in ("no_such_column > 2", "events >"):
        kept, warning = tables.filtered(table, "o1", wrong)
        assert kept.count() == 2 and "invalid expression" in warning
    assert tuple(tables.kept_share(table, "events > 2").first()) == (2, 3, 2 / 3)


def test_a_larger_table_begins_with_more_partitions(spark, monkeypatch, tmp_path):
    """A task's share of a shuffle is bounded by its bytes, not by a number of partitions that ignores the input."""
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    few = session.sized_for(spark, table)
    monkeypatch.setattr(session, "BYTES_A_PARTITION", 1000)
    many = session.sized_for(spark, table)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) < many
    counted = table.groupBy((table.id % 7).alias("k")).count()
    assert f", {many})" in counted._jdf.queryExecution().executedPlan().toString() and counted.count() == 7
    monkeypatch.undo()
    session.sized_for(spark, table)
