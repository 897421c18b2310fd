"""Data-quality reports: each invariant with the number of rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.functions.calendar import Period


def _long(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    return counts.select(*[F.col(name).cast("bigint").alias(name) for name in names]).unpivot(
        [], list(names), "check", "violations"
    )


def log_invariants(log: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """One operator and one source per session, from map-side minima and maxima instead of sets."""
    per_session = log.groupBy(*by, "session_id").agg(
        (F.min("operator_id") != F.max("operator_id")).alias("_operators"),
        (F.min("source_ip") != F.max("source_ip")).alias("_sources"),
    )
    counts = per_session.agg(
        F.count_if("_operators").alias("several_operators"), F.count_if("_sources").alias("several_sources")
    )
    return _long(counts, ["several_operators", "several_sources"])


def session_invariants(sessions: DataFrame, log: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Openings equal the first event, shares are bounded, attributes are present and not negative."""
    first = log.groupBy(*by, "session_id").agg(F.min("timestamp").alias("_first"))
    joined = sessions.join(first, [*by, "session_id"], "left")
    counts = joined.agg(
        F.count_if(F.col("_first").isNull() | (F.col("opened_at") != F.col("_first"))).alias("wrong_opening"),
        F.count_if((F.col("failures_per_event") > 1) | (F.col("failures_per_event") < 0)).alias("failure_share"),
        F.count_if(F.col("denials_per_event") > F.col("failures_per_event")).alias("more_denials_than_failures"),
        F.count_if(F.col("distinct_keys") > F.col("events")).alias("more_keys_than_events"),
        F.count_if(F.col("requests_per_minute").isNull() | (F.col("requests_per_minute") < 0)).alias("bad_pace"),
    )
    return _long(
        counts,
        ["wrong_opening", "failure_share", "more_denials_than_failures", "more_keys_than_events", "bad_pace"],
    ).unionByName(log_invariants(log, by))


def request_period_report(
    requests: DataFrame, operators: DataFrame, period: Period, by: Sequence[str] = ("seed",)
) -> DataFrame:
    """Operators without traffic, requests outside the period, sources that are not a usual address."""
    silent = operators.join(requests.select(*by, "operator_id").distinct(), [*by, "operator_id"], "left_anti").agg(
        F.count("*").alias("n")
    )
    inside = F.lit(False)
    for phase in ("warmup", "evaluated"):
        inside = inside | period.belongs_to(phase, F.col("timestamp"))
    outside = requests.agg(F.count_if(~inside).alias("n"))
    usual = operators.select(*by, "operator_id", F.explode("usual_ips").alias("source_ip")).distinct()
    used = requests.groupBy(*by, "operator_id", "source_ip").agg(F.count("*").alias("_n"))
    foreign = used.join(usual, [*by, "operator_id", "source_ip"], "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n")
    )
    parts = {"silent_operators": silent, "outside_period": outside, "foreign_sources": foreign}
    rows = [table.select(F.lit(name).alias("check"), F.col("n").alias("violations")) for name, table in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
