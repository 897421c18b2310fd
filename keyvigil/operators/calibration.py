"""Thresholds of the six magnitude rules, learnt from the clean warm-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.functions.calendar import WARMUP, Period
from keyvigil.functions.rates import half_even
from keyvigil.operators.ordering import quantiles
from keyvigil.schemas import MAGNITUDE_ATTRIBUTES, THRESHOLD_PERCENTILE


def in_long_form(sessions: DataFrame, keep: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per (session, attribute), every value as a double."""
    values = [F.col(name).cast("double").alias(name) for name in attributes]
    return sessions.select(*keep, *values).unpivot(list(keep), list(attributes), "attribute", "value")


def thresholds(
    sessions: DataFrame, by: Sequence[str] = ("seed",), method: str = "exact", accuracy: int = 10_000
) -> DataFrame:
    """The 99th percentile of each magnitude attribute, one row per (replica, attribute).

    `exact` interpolates between order statistics. `approximate` gives the sketch of the built-in percentile, in one
    pass over the sessions, for data where a bounded rank error is good enough.
    """
    by = list(by)
    share = THRESHOLD_PERCENTILE / 100
    long = in_long_form(sessions, by, MAGNITUDE_ATTRIBUTES)
    key = [*by, "attribute"]
    if method == "exact":
        found = quantiles(long, key, "value", {"threshold": share}, count="sessions")
    elif method == "approximate":
        found = long.groupBy(*key).agg(
            F.percentile_approx("value", share, accuracy).alias("threshold"), F.count("value").alias("sessions")
        )
    else:
        raise ValueError(f"unknown method {method!r}, expected 'exact' or 'approximate'")
    return found.select(
        *key,
        half_even(F.col("threshold")).alias("threshold"),
        F.lit(THRESHOLD_PERCENTILE).alias("percentile"),
        "sessions",
    )


def ruler_period(sessions: DataFrame, period: Period) -> DataFrame:
    return sessions.where(period.belongs_to(WARMUP, F.col("opened_at")))


def require_calibration(sessions: DataFrame, period: Period) -> None:
    if not ruler_period(sessions, period).take(1):
        raise ValueError("no session opened in the warm-up, nothing to calibrate on")


def threshold_set_differences(table: DataFrame) -> DataFrame:
    """Attributes missing from or foreign to a threshold table; empty when the six are all there."""
    expected = table.sparkSession.createDataFrame([(name,) for name in MAGNITUDE_ATTRIBUTES], "attribute string")
    found = table.select("attribute").distinct()
    missing = expected.exceptAll(found).withColumn("side", F.lit("missing"))
    return missing.unionByName(found.exceptAll(expected).withColumn("side", F.lit("foreign")))


SHOWN_IN_ERRORS = 20


def require_threshold_set(table: DataFrame) -> None:
    wrong = threshold_set_differences(table).select("attribute").distinct()
    shown = [row.attribute for row in wrong.orderBy("attribute").take(SHOWN_IN_ERRORS)]
    if shown:
        more = wrong.count() - len(shown)
        raise ValueError(f"threshold table differs from the six magnitude rules at {shown}" + f" and {more} more" * (more > 0))


def replicas_without_thresholds(sessions: DataFrame, table: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Replicas that have sessions but not all six thresholds."""
    whole = (
        table.where(F.col("attribute").isin(*MAGNITUDE_ATTRIBUTES) & F.col("threshold").isNotNull())
        .groupBy(*by).agg(F.count_distinct("attribute").alias("_n")).where(F.col("_n") == len(MAGNITUDE_ATTRIBUTES))
    )
    return sessions.select(*by).distinct().join(whole, list(by), "left_anti").select(*by)


def require_thresholds_of(sessions: DataFrame, table: DataFrame, by: Sequence[str] = ("seed",)) -> None:
    missing = replicas_without_thresholds(sessions, table, by).take(1)
    if missing:
        raise ValueError(f"replica {tuple(missing[0])} has sessions but no complete set of thresholds")


def cutoffs(table: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Six cutoffs per replica in one row."""
    return (
        table.groupBy(*by)
        .pivot("attribute", list(MAGNITUDE_ATTRIBUTES))
        .agg(F.first("threshold"))
        .select(*by, *[F.col(name).alias(f"cutoff_{name}") for name in MAGNITUDE_ATTRIBUTES])
    )
