"""The same decisions and attributes on a stream of requests, against frozen tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keyvigil.functions import rates
from keyvigil.operators import policy, rules, sessions
from keyvigil.session import new_folder

# Event time of the stream as Spark's watermarks need it.
MOMENT = "_moment"
# The map side merges a session's rows before the shuffle, so a very busy session travels as one state per task.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def request_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def without_repeats(stream: DataFrame, lateness: str = "1 hour", by: Sequence[str] = ("seed",), event: str = "event_id") -> DataFrame:
    """Each event once, however often it is delivered.

    The state holds the ids of the last `lateness` only: a repetition within it is recognised, and one that comes after it is
    older than the watermark and dropped as late. `late_rows` counts what was dropped.
    """
    timed = stream.withColumn(MOMENT, F.col("timestamp").cast("timestamp")).withWatermark(MOMENT, lateness)
    return timed.dropDuplicatesWithinWatermark([*by, event])


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful steps of a query have left out because they were older than the watermark."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in json.loads(p.json)["stateOperators"])


def streaming_decisions(
    stream: DataFrame, keys: DataFrame, grants: DataFrame, by: Sequence[str] = (), key_by: Sequence[str] | None = None
) -> DataFrame:
    """Stateless: two stream-static lookups and a CASE, the batch function as it is."""
    return policy.decided(stream, keys, grants, by, key_by)


def streaming_sessions(
    log: DataFrame, gap: str = "2 days", lateness: str = "1 hour", by: Sequence[str] = ("seed",),
    key_error: float | None = None,
) -> DataFrame:
    """Session attributes, emitted once the watermark has passed the end of the session plus the gap.

    Rows later than `lateness` are dropped; a session with a pause longer than `gap` comes out in parts. Exact
    distinct counts do not exist on streams, so the keys of an open session are kept as a set. Where sessions may use
    very many keys, `key_error` (a relative standard deviation, say 0.01) keeps a sketch of fixed size instead.
    """
    keys = F.size(F.collect_set("key_id")) if key_error is None else F.approx_count_distinct("key_id", key_error)
    log.sparkSession.conf.set(LOCAL_MERGE, "true")
    timed = log
    if MOMENT not in log.columns:  # else `without_repeats` has set the watermark
        timed = log.withColumn(MOMENT, F.col("timestamp").cast("timestamp")).withWatermark(MOMENT, lateness)
    opening = F.min(F.struct("timestamp", "event_id", "operator_id", "source_ip"))
    grouped = (
        timed.groupBy(F.session_window(MOMENT, gap), *by, "session_id")
        .agg(
            opening.alias("_opening"),
            F.max("timestamp").alias("closed_at"),
            F.count("*").alias("events"),
            keys.cast("bigint").alias("distinct_keys"),
            rates.failures(F.col("outcome")).alias("failures"),
            rates.denials(F.col("outcome")).alias("denials"),
        )
        .select(
            *by,
            "session_id",
            F.col("_opening.operator_id").alias("operator_id"),
            F.col("_opening.source_ip").alias("source_ip"),
            F.col("_opening.timestamp").alias("opened_at"),
            "closed_at",
            "events",
            "distinct_keys",
            "failures",
            "denials",
        )
    )
    return sessions.with_rates(grouped)


def streaming_alerts(
    stream: DataFrame, windows: DataFrame, sources: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("seed",)
) -> DataFrame:
    """Closed sessions with flags and decision; profiles and thresholds are frozen since the warm-up."""
    full = sessions.with_history(stream, windows, sources, by)
    return rules.with_rules(full, thresholds, by)


def stage(requests: DataFrame, name: str, closing: bool = True) -> str:
    """Requests as Parquet files a file stream can read.

    With `closing`, a far-future row is added that moves the watermark past the last session.
    """
    folder = new_folder(requests.sparkSession, name)
    requests.write.parquet(folder)
    if not closing:
        return folder
    kinds = {field.name: field.dataType for field in requests.schema}
    # No NULLs: a filter for a later join would take the row away before the watermark sees it.
    values = {
        column: F.lit("marker" if isinstance(kind, T.StringType) else 0).cast(kind)
        for column, kind in kinds.items()
        if column != "timestamp"
    }
    values["timestamp"] = F.lit("2999-01-01 00:00:00").cast(kinds["timestamp"])
    marker = requests.sparkSession.range(1).select(*[values[column].alias(column) for column in kinds])
    marker.write.mode("append").parquet(folder)
    return folder


def run_available(stream: DataFrame, name: str, folders: tuple[str, str] | None = None, finished: list | None = None) -> DataFrame:
    """Everything that has arrived, through to a Parquet sink with its own checkpoint, read back as a table.

    `folders` (sink, checkpoint) of an earlier run continue it; `finished` receives the query, for its progress.
    """
    spark = stream.sparkSession
    sink, progress = folders or (new_folder(spark, f"{name}-out"), new_folder(spark, f"{name}-progress"))
    started = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(sink)
    )
    started.awaitTermination()
    if finished is not None:
        finished.append(started)
    return spark.read.schema(stream.schema).parquet(sink)
