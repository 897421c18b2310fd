"""Streams give what the batch gives, also over several micro-batches."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyvigil.operators import policy, sessions
from keyvigil.session import new_folder
from keyvigil.streaming import jobs

FIELDS = "event_id string, session_id string, operator_id string, timestamp timestamp_ntz, source_ip string, operation string, key_id string, seed bigint"


@pytest.fixture(scope="module")
def requests(spark):
    start = datetime(2024, 1, 1)
    rows = []
    for number in range(240):
        block, user = number // 24, number % 4
        # One user has most of the rows of a block.
        owner = 0 if number % 3 else user
        moment = start + timedelta(days=2 * block, minutes=7 * (number % 24))
        rows.append((f"e{number:04d}", f"s{owner}-{block}", f"o{owner}", moment, f"10.0.0.{owner}", "Decrypt", f"k{number % 5}", owner % 2 + 1))
    return spark.createDataFrame(rows, FIELDS).cache()


@pytest.fixture(scope="module")
def repository(spark):
    keys = spark.createDataFrame([("k0", "a", "active"), ("k1", "b", "disabled"), ("k2", "c", "active")], "key_id string, scope string, status string")
    grants = spark.createDataFrame([(f"o{n}", scope) for n in range(4) for scope in ("a", "b")], "operator_id string, scope string")
    return keys, grants


def _in_time_order(requests, files: int) -> str:
    """Files that arrive one after the other, oldest rows first, with the closing row last."""
    spark = requests.sparkSession
    folder = new_folder(spark, "arrivals")
    ordered = requests.orderBy("timestamp", "event_id").collect()
    size = -(-len(ordered) // files)
    for number in range(files):
        part = spark.createDataFrame(ordered[number * size : (number + 1) * size], requests.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    marker = spark.createDataFrame([("marker", "marker", "marker", datetime(2999, 1, 1), "m", "m", "m", 0)], requests.schema)
    marker.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_decisions_equal_batch(spark, requests, repository):
    folder = jobs.stage(requests, "requests", closing=False)
    stream = jobs.streaming_decisions(jobs.request_stream(spark, folder, requests.schema), *repository)
    found = jobs.run_available(stream.select("event_id", "outcome"), "decisions")
    assert sorted(found.collect()) == sorted(policy.outcomes(requests, *repository).collect())


@pytest.mark.parametrize("files", [1, 4])
def test_sessions_equal_batch(spark, requests, repository, files):
    stream = jobs.request_stream(spark, _in_time_order(requests, files), requests.schema, files_per_batch=1)
    live = jobs.streaming_sessions(jobs.streaming_decisions(stream, *repository), gap="1 day")
    found = jobs.run_available(live, "sessions")
    batch = sessions.with_rates(sessions.per_session(policy.decided(requests, *repository)))
    assert sorted(found.select(batch.columns).collect()) == sorted(batch.collect())


def test_redelivered_batches_change_nothing_and_late_rows_are_counted(spark, requests, repository):
    """Three runs on one checkpoint: a batch, the same batch again with the next one, then rows far behind the watermark."""
    early = requests.where("timestamp < timestamp_ntz'2024-01-09 00:00:00'")
    rest = requests.where("timestamp >= timestamp_ntz'2024-01-09 00:00:00'")
    folder = new_folder(spark, "arrivals")
    folders = new_folder(spark, "out"), new_folder(spark, "progress")
    found, counts = None, []
    for part in (early, rest.unionByName(rest), early.limit(7)):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.without_repeats(jobs.request_stream(spark, folder, requests.schema))
        queries: list = []
        decided = jobs.streaming_decisions(stream, *repository).select("event_id", "outcome")
        found = jobs.run_available(decided, "again", folders, queries)
        counts.append(jobs.late_rows(queries[0]))
    assert sorted(found.collect()) == sorted(policy.outcomes(requests, *repository).collect())
    assert counts == [0, 0, 7]


def test_sessions_of_redelivered_requests(spark, requests, repository):
    folder = jobs.stage(requests.unionByName(requests), "twice")
    stream = jobs.without_repeats(jobs.request_stream(spark, folder, requests.schema))
    found = jobs.run_available(jobs.streaming_sessions(jobs.streaming_decisions(stream, *repository), gap="1 day"), "twice")
    batch = sessions.with_rates(sessions.per_session(policy.decided(requests, *repository)))
    assert sorted(found.select(batch.columns).collect()) == sorted(batch.collect())


def test_sessions_with_a_sketch_of_their_keys(spark, requests, repository):
    stream = jobs.request_stream(spark, _in_time_order(requests, 1), requests.schema)
    live = jobs.streaming_sessions(jobs.streaming_decisions(stream, *repository), gap="1 day", key_error=0.01)
    found = {r.session_id: r.distinct_keys for r in jobs.run_available(live, "sketched").collect()}
    batch = sessions.per_session(policy.decided(requests, *repository)).collect()
    assert found == {r.session_id: r.distinct_keys for r in batch}


def test_a_long_pause_splits_a_session(spark, requests, repository):
    one = requests.where(F.col("session_id") == "s0-0").withColumn("session_id", F.lit("x"))
    later = one.withColumn("timestamp", F.expr("timestamp + interval 5 days")).withColumn("event_id", F.concat(F.lit("z"), "event_id"))
    folder = jobs.stage(one.unionByName(later), "paused")
    stream = jobs.request_stream(spark, folder, requests.schema)
    found = jobs.run_available(jobs.streaming_sessions(jobs.streaming_decisions(stream, *repository)), "paused")
    assert found.count() == 2 and found.agg(F.sum("events")).first()[0] == 2 * one.count()


def test_checkpoint_folder_of_the_session_is_used(spark):
    folder = new_folder(spark, "probe")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert folder.startswith(named.rstrip("/")) and os.path.basename(folder).startswith("probe-")
