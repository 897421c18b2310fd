"""Event and session numbers, and merging a supplied campaign into the legitimate traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.functions.calendar import EVALUATED, Period
from keyvigil.functions.text import identifier
from keyvigil.operators.ordering import numbered
from keyvigil.session import written

CHRONOLOGICAL = ("timestamp", "session_id", "event_id")

# Digits of the numbers.
EVENT_DIGITS = 6
SESSION_DIGITS = 5


def with_event_numbers(requests: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Requests in time order within each replica, with `position` and the event id that follows from it."""
    placed = numbered(requests, by, CHRONOLOGICAL, "position")
    return placed.withColumn("event_number", identifier("event", F.col("position"), EVENT_DIGITS))


def session_numbers(placed: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Old session id to new, numbered by first appearance."""
    first = placed.groupBy(*by, "session_id").agg(F.min("position").alias("first_position"))
    order = numbered(first, by, ("first_position", "session_id"), "session_position")
    return order.withColumn("session_number", identifier("session", F.col("session_position"), SESSION_DIGITS))


def legitimate_of_evaluated(requests: DataFrame, period: Period) -> DataFrame:
    return requests.where(period.belongs_to(EVALUATED, F.col("timestamp"))).drop("event_id")


def merged(legitimate: DataFrame, campaign: DataFrame, by: Sequence[str] = ("seed",)) -> tuple[DataFrame, DataFrame]:
    """Traffic with the campaign inside, renumbered from one, and the label table in the new numbers.

    The merged rows carry no mark of their origin; only the label table tells.
    """
    both = legitimate.withColumn("_campaign", F.lit(0)).unionByName(campaign.withColumn("_campaign", F.lit(1)))
    placed = written(with_event_numbers(both, by), "merged")
    names = session_numbers(placed, by).select(*by, "session_id", "session_number")
    marked = placed.where(F.col("_campaign") == 1).select(*by, "session_id").distinct()
    traffic = placed.join(names, [*by, "session_id"]).drop("_campaign")
    labels = marked.join(names, [*by, "session_id"]).select(*by, "session_number")
    return traffic, labels
