"""Phases, weeks and day spines as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WARMUP = "warmup"
EVALUATED = "evaluated"
PHASES = (WARMUP, EVALUATED)
DAYS_PER_WEEK = 7

# Fixed value: Monday to Friday, counted from Monday = 0.
BUSINESS_WEEKDAYS = (0, 1, 2, 3, 4)


@dataclass(frozen=True)
class Period:
    """A first day and the number of weeks of each phase, warm-up before evaluated."""

    # The published period.
    first_day: date = date(2026, 1, 5)
    warmup_weeks: int = 4
    evaluated_weeks: int = 4

    @property
    def weeks(self) -> int:
        return self.warmup_weeks + self.evaluated_weeks

    @property
    def days(self) -> int:
        return self.weeks * DAYS_PER_WEEK

    def first_day_of(self, week: int) -> date:
        return self.first_day + timedelta(days=(week - 1) * DAYS_PER_WEEK)

    def day_after_last_of(self, week: int) -> date:
        return self.first_day_of(week + 1)

    def bounds(self, phase: str) -> tuple[date, date]:
        """First day and the day after the last one; a phase of another name is refused."""
        middle = self.first_day_of(self.warmup_weeks + 1)
        known = {
            WARMUP: (self.first_day, middle),
            EVALUATED: (middle, self.day_after_last_of(self.weeks)),
        }
        if phase not in known:
            raise ValueError(f"unknown phase {phase!r}, expected one of {PHASES}")
        return known[phase]

    def belongs_to(self, phase: str, moment: Column) -> Column:
        """Half-open test, so that midnight after the last day is outside. Plain bounds reach the scan."""
        opens, closes = self.bounds(phase)
        return (moment >= _midnight(opens)) & (moment < _midnight(closes))

    def phase_of(self, moment: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for phase in reversed(PHASES):
            chosen = F.when(self.belongs_to(phase, moment), F.lit(phase)).otherwise(chosen)
        return chosen

    def week_of(self, moment: Column) -> Column:
        """Week number counted from 1; other periods continue the count on both sides."""
        passed = F.datediff(moment, F.lit(self.first_day))
        return (F.floor(passed / F.lit(float(DAYS_PER_WEEK))) + 1).cast("bigint")

    def phase_days(self, phase: str | None = None) -> Column:
        """All days of a phase, or of the whole period, as one array to explode."""
        if phase is None:
            opens, closes = self.first_day, self.day_after_last_of(self.weeks)
        else:
            opens, closes = self.bounds(phase)
        last = closes - timedelta(days=1)
        return F.sequence(F.lit(opens), F.lit(last), F.expr("interval 1 day"))

    def day_spine(self, spark: SparkSession, phase: str | None = None) -> DataFrame:
        return spark.range(1).select(F.explode(self.phase_days(phase)).alias("day"))

    def week_table(self, spark: SparkSession) -> DataFrame:
        weeks = spark.range(1, self.weeks + 1).select(F.col("id").alias("week"))
        first = F.date_add(F.lit(self.first_day), ((F.col("week") - 1) * DAYS_PER_WEEK).cast("int"))
        return weeks.select(
            "week", first.alias("first_day"), F.date_add(first, DAYS_PER_WEEK).alias("day_after_last")
        )


def _midnight(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def is_business_day(day: Column) -> Column:
    return F.weekday(day).isin(*BUSINESS_WEEKDAYS)


def clock(moment: Column) -> Column:
    """Time of day as fixed-width text, whose alphabetical order is the order in time."""
    return F.date_format(moment, "HH:mm:ss")


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def seconds_of_day(text: Column) -> Column:
    parts = F.split(text, ":")
    return (
        F.element_at(parts, 1).cast("bigint") * 3600
        + F.element_at(parts, 2).cast("bigint") * 60
        + F.element_at(parts, 3).cast("bigint")
    )


def minutes_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(6.0e7)
