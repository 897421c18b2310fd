"""From the audit log to sessions with eight attributes, and to the profile of each operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.functions import rates
from keyvigil.functions.calendar import EVALUATED, PHASES, clock, minutes_between, seconds_of_day
from keyvigil.functions.rates import half_even
from keyvigil.schemas import ATTRIBUTES, IDENTIFIERS, LABEL

# Fixed value: the shortest duration a rate is taken over, one second in minutes.
SHORTEST_MEASURABLE_MINUTES = 1 / 60


def per_session(log: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """One grouping for all counts of a session.

    The opening is the least (time, event) together with its operator and source. Everything combines on the map
    side, and the distinct keys are shuffled by (session, key) before they are counted, so one session with a third
    of the log is spread over its keys.
    """
    opening = F.min(F.struct("timestamp", "event_id", "operator_id", "source_ip"))
    return (
        log.groupBy(*by, "session_id")
        .agg(
            opening.alias("_opening"),
            F.max("timestamp").alias("closed_at"),
            F.count("*").alias("events"),
            F.count_distinct("key_id").alias("distinct_keys"),
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


def with_rates(sessions: DataFrame) -> DataFrame:
    """Duration, pace and the two failure ratios. The pace uses the duration before it is rounded."""
    minutes = minutes_between(F.col("opened_at"), F.col("closed_at"))
    measurable = F.greatest(minutes, F.lit(SHORTEST_MEASURABLE_MINUTES))
    return sessions.select(
        "*",
        half_even(minutes).alias("duration_minutes"),
        half_even(F.col("events") / measurable).alias("requests_per_minute"),
        half_even(F.col("failures") / F.col("events")).alias("failures_per_event"),
        half_even(F.col("denials") / F.col("events")).alias("denials_per_event"),
    )


def openings(log: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Operator, source and time of the earliest event of each session."""
    first = F.min(F.struct("timestamp", "event_id", "operator_id", "source_ip"))
    return (
        log.groupBy(*by, "session_id")
        .agg(first.alias("_opening"))
        .select(
            *by,
            "session_id",
            F.col("_opening.operator_id").alias("operator_id"),
            F.col("_opening.source_ip").alias("source_ip"),
            F.col("_opening.timestamp").alias("opened_at"),
        )
    )


def usual_windows(opened: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Earliest and latest opening time of day of each operator, with the session count.

    Seconds of the day are compared instead of text, which keeps the aggregation a hash aggregation.
    """
    moment = F.col("opened_at")
    second = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    grouped = opened.groupBy(*by, "operator_id").agg(
        F.min(second).alias("_first"), F.max(second).alias("_last"), F.count("*").alias("session_count")
    )
    return grouped.select(
        *by,
        "operator_id",
        clock(F.timestamp_seconds("_first")).alias("window_opens_at"),
        clock(F.timestamp_seconds("_last")).alias("window_closes_at"),
        "session_count",
    )


def seen_sources(opened: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Distinct (operator, source) pairs: the long form of the address list, which never has to fit in one row."""
    return opened.select(*by, "operator_id", "source_ip").distinct()


def profiles(opened: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """The profile table with the sources as one multi-value cell per operator.

    Sources are made distinct before they are listed, so the list is as long as the cell it fills.
    """
    listed = (
        seen_sources(opened, by)
        .groupBy(*by, "operator_id")
        .agg(F.array_sort(F.collect_list("source_ip")).alias("observed_ips"))
    )
    return usual_windows(opened, by).join(listed, [*by, "operator_id"]).select(
        *by, "operator_id", "window_opens_at", "window_closes_at", "observed_ips", "session_count"
    )


def window_width_hours(profile: DataFrame) -> DataFrame:
    width = seconds_of_day(F.col("window_closes_at")) - seconds_of_day(F.col("window_opens_at"))
    return profile.withColumn("width_hours", width / F.lit(3600.0))


def with_history(
    sessions: DataFrame, windows: DataFrame, sources: DataFrame, by: Sequence[str] = ("seed",)
) -> DataFrame:
    """`atypical_hour` and `new_source_ip` against the profile.

    An operator without a profile has no usual hour and no usual source, so both are 1: nothing of a stranger is
    typical, and every session gets a decision. Where strangers are an error, `require_profiles` says so.
    """
    usual = windows.select(*by, "operator_id", "window_opens_at", "window_closes_at")
    seen = sources.select(*by, "operator_id", "source_ip", F.lit(1).alias("_seen"))
    hour = clock(F.col("opened_at"))
    inside = (hour >= F.col("window_opens_at")) & (hour <= F.col("window_closes_at"))
    return (
        sessions.join(usual, [*by, "operator_id"], "left")
        .join(seen, [*by, "operator_id", "source_ip"], "left")
        .withColumn("atypical_hour", F.coalesce((~inside).cast("int"), F.lit(1)))
        .withColumn("new_source_ip", F.col("_seen").isNull().cast("int"))
        .drop("window_opens_at", "window_closes_at", "_seen")
    )


def with_profile_cells(sessions: DataFrame, profile: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """The same two attributes from a profile table that carries its sources as a multi-value cell."""
    sources = profile.select(*by, "operator_id", F.explode("observed_ips").alias("source_ip")).distinct()
    return with_history(sessions, profile, sources, by)


def operators_without_profile(sessions: DataFrame, windows: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    return sessions.join(windows.select(*by, "operator_id"), [*by, "operator_id"], "left_anti")


def require_profiles(sessions: DataFrame, windows: DataFrame, by: Sequence[str] = ("seed",)) -> None:
    missing = operators_without_profile(sessions, windows, by).select("operator_id").take(1)
    if missing:
        raise KeyError(f"operator {missing[0][0]!r} has sessions but no profile from the warm-up")


def with_label(sessions: DataFrame, compromised: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """1 where the session is in the label table, else 0."""
    marks = compromised.select(*by, "session_id").distinct().withColumn("_mark", F.lit(1))
    return (
        sessions.join(marks, [*by, "session_id"], "left")
        .withColumn(LABEL, F.col("_mark").isNotNull().cast("int"))
        .drop("_mark")
    )


def columns_of(phase: str) -> tuple[str, ...]:
    """Identifiers and attributes; the label exists in the evaluated phase only."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}, expected one of {PHASES}")
    return IDENTIFIERS + ATTRIBUTES + ((LABEL,) if phase == EVALUATED else ())


def require_label(sessions: DataFrame) -> None:
    if LABEL not in sessions.columns:
        raise ValueError("these sessions carry no label; only the evaluated phase has one")


def session_table(
    log: DataFrame,
    windows: DataFrame,
    sources: DataFrame,
    phase: str,
    compromised: DataFrame | None = None,
    by: Sequence[str] = ("seed",),
) -> DataFrame:
    """The session table of a phase. A label table is required in the evaluated phase and refused in the other."""
    columns = columns_of(phase)
    if phase == EVALUATED and compromised is None:
        raise ValueError("the evaluated phase needs the table of compromised sessions")
    if phase != EVALUATED and compromised is not None:
        raise ValueError("the warm-up has no compromised sessions, a label table does not belong there")
    built = with_history(with_rates(per_session(log, by)), windows, sources, by)
    if compromised is not None:
        built = with_label(built, compromised, by)
    return built.select(*by, *columns)
