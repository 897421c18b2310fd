"""Descriptive tables: traffic behaviour, rule behaviour, thresholds over replicas, expected beside observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyvigil.functions import distributions as dist
from keyvigil.functions.calendar import EVALUATED, Period, is_business_day, minutes_between
from keyvigil.functions.rates import half_even, share
from keyvigil.operators.calibration import in_long_form
from keyvigil.operators.evaluation import confusion_counts
from keyvigil.operators.ordering import integer_spine, quantiles, with_previous
from keyvigil.functions import rates
from keyvigil.schemas import (
    ATTRIBUTES,
    CUSTODY_DISPERSION,
    DECLARED_MIX,
    LABEL,
    MAGNITUDE_ATTRIBUTES,
    OPERATIONS,
    PRIMARY_ADDRESS_SHARE,
    REGIMES,
    RULE_COLUMNS,
)

# Bins of a continuous histogram, shortest axis of sessions per day.
HISTOGRAM_BINS = 30
SHORTEST_COUNT_AXIS = 8

# Bar widths in seconds to choose from, bars up to four means.
GAP_WIDTHS = (1, 2, 5, 10, 20, 30, 60)
GAP_BARS = 20


def gap_widths(decades: int = 9) -> list[int]:
    """The fixed widths, then round numbers of minutes in every further decade."""
    return [*GAP_WIDTHS, *(GAP_WIDTHS[-1] * step * 10**k for k in range(decades) for step in (2, 5, 10))]



# --- traffic -------------------------------------------------------------------------------------------------------


def traffic_sessions(requests: DataFrame, operators: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """One row per session: owner, regime, opening, end, size, minutes, source, and whether from the primary address."""
    opening = F.min(F.struct("timestamp", "event_id", "operator_id", "source_ip"))
    grouped = (
        requests.groupBy(*by, "session_id")
        .agg(opening.alias("_opening"), F.max("timestamp").alias("closed_at"), F.count("*").alias("events"))
        .select(
            *by,
            "session_id",
            F.col("_opening.operator_id").alias("operator_id"),
            F.col("_opening.timestamp").alias("opened_at"),
            "closed_at",
            "events",
            F.col("_opening.source_ip").alias("source_ip"),
        )
    )
    owners = operators.select(*by, "operator_id", "profile", "regime", F.element_at("usual_ips", 1).alias("_primary"))
    return (
        grouped.join(owners, [*by, "operator_id"], "left")
        .withColumn("minutes", minutes_between(F.col("opened_at"), F.col("closed_at")))
        .withColumn("from_primary", F.col("source_ip") == F.col("_primary"))
        .drop("_primary")
    )


def business_day_counts(
    sessions: DataFrame, operators: DataFrame, period: Period, by: Sequence[str] = ("seed",)
) -> DataFrame:
    """Sessions of each operator on each business day of the period, 0 on the days without any."""
    days = F.filter(period.phase_days(), is_business_day)
    spine = operators.select(*by, "operator_id", "regime", F.explode(days).alias("day"))
    counted = sessions.groupBy(*by, "operator_id", F.to_date("opened_at").alias("day")).agg(F.count("*").alias("_n"))
    return (
        spine.join(counted, [*by, "operator_id", "day"], "left")
        .withColumn("sessions", F.coalesce(F.col("_n"), F.lit(0)))
        .drop("_n")
    )


def shares_on_axis(
    values: DataFrame,
    group: Sequence[str],
    value: str,
    low: Column,
    high: Column,
    name: str = "share",
    mean: str | None = None,
) -> DataFrame:
    """Share of the rows at each whole number of an axis; rows off the axis still count in the denominator.

    `low` and `high` may use `_max`, the largest value of the group. With `mean`, the mean of the group comes along;
    it is taken from the same counts, so the rows are read once.
    """
    group = list(group)
    counted = values.groupBy(*group, value).agg(F.count("*").alias("_n"))
    totals = counted.groupBy(*group).agg(
        F.sum("_n").alias("_all"),
        F.max(value).alias("_max"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("_mean"),
    )
    spine = integer_spine(totals, low, high, value)
    return spine.join(counted, [*group, value], "left").select(
        *group,
        value,
        share(F.coalesce(F.col("_n"), F.lit(0)), F.col("_all")).alias(name),
        *([F.col("_mean").alias(mean)] if mean else []),
    )


def share_by_regime(sessions: DataFrame, part: Column, size: int, name: str) -> DataFrame:
    """Share of each regime's sessions per hour, weekday, ...: one column per regime, 0 where nothing falls."""
    counted = sessions.groupBy(part.cast("bigint").alias(name)).agg(
        *[F.count_if(F.col("regime") == regime).alias(regime) for regime in REGIMES]
    )
    spine = sessions.sparkSession.range(size).select(F.col("id").alias(name))
    # At most 24 rows, so one window over all of them gives the totals.
    whole = W.partitionBy()
    columns = [
        F.coalesce(share(F.coalesce(F.col(regime), F.lit(0)), F.sum(regime).over(whole)), F.lit(0.0)).alias(regime)
        for regime in REGIMES
    ]
    return spine.join(counted, name, "left").select(name, *columns)


def hour_share(sessions: DataFrame) -> DataFrame:
    return share_by_regime(sessions, F.hour("opened_at"), 24, "hour")


def weekday_share(sessions: DataFrame) -> DataFrame:
    return share_by_regime(sessions, F.weekday("opened_at"), 7, "weekday")


def session_size_share(sessions: DataFrame, name: str = "share", mean: str | None = None) -> DataFrame:
    return shares_on_axis(sessions, ["regime"], "events", F.lit(1), F.col("_max"), name, mean)


def daily_count_share(daily: DataFrame, name: str = "share", mean: str | None = None) -> DataFrame:
    """From 0 to the busiest day, and to 8 at least."""
    longest = F.greatest(F.lit(SHORTEST_COUNT_AXIS).cast("bigint"), F.col("_max"))
    return shares_on_axis(daily, ["regime"], "sessions", F.lit(0), longest, name, mean)


def operation_mix(requests: DataFrame, operators: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Measured and declared operation shares of each profile, and the largest gap between them.

    Requests are counted per (operator, operation) before they meet the operators.
    """
    counted = requests.groupBy(*by, "operator_id", "operation").agg(F.count("*").alias("_n"))
    per_profile = (
        counted.join(operators.select(*by, "operator_id", "profile"), [*by, "operator_id"])
        .groupBy("profile", "operation")
        .agg(F.sum("_n").alias("_n"))
    )
    declared = requests.sparkSession.createDataFrame(
        [(profile, op, share_) for profile, mix in DECLARED_MIX.items() for op, share_ in mix.items()],
        "profile string, operation string, declared double",
    )
    whole = per_profile.groupBy("profile").agg(F.sum("_n").alias("_all"))
    measured = share(F.coalesce(F.col("_n"), F.lit(0)), F.col("_all"))
    mixed = (
        declared.join(per_profile, ["profile", "operation"], "left")
        .join(whole, "profile")
        .select("profile", "operation", "declared", measured.alias("measured"))
    )
    gap = F.abs(F.col("measured") - F.col("declared"))
    return mixed.withColumn("largest_gap", F.max(gap).over(W.partitionBy("profile")))


def regime_overview(sessions: DataFrame, operators: DataFrame) -> DataFrame:
    """Per regime: profile, operators, sessions and median duration in minutes."""
    people = operators.groupBy("regime").agg(F.min("profile").alias("profile"), F.count("*").alias("operators"))
    measured = quantiles(sessions, ["regime"], "minutes", {"median_minutes": 0.5}, count="sessions")
    return people.join(measured, "regime", "left").select(
        "regime", "profile", "operators", F.coalesce("sessions", F.lit(0)).alias("sessions"), "median_minutes"
    )


def median_sessions_per_operator(sessions: DataFrame, period: Period, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Median number of sessions an operator of each regime has in the evaluated phase."""
    counted = (
        sessions.where(period.belongs_to(EVALUATED, F.col("opened_at")))
        .groupBy(*by, "regime", "operator_id")
        .agg(F.count("*").alias("_n"))
    )
    return quantiles(counted, ["regime"], "_n", {"median_sessions": 0.5}, count="operators")


def dispersion_index(sessions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Variance over mean of the sessions per operator and active day, by regime."""
    daily = sessions.groupBy(*by, "regime", "operator_id", F.to_date("opened_at").alias("day")).agg(
        F.count("*").alias("_n")
    )
    return daily.groupBy("regime").agg(
        F.count("*").alias("operator_days"), F.try_divide(F.var_samp("_n"), F.avg("_n")).alias("dispersion")
    )


# --- observed beside expected --------------------------------------------------------------------------------------


def daily_counts_expected(daily: DataFrame) -> DataFrame:
    """Sessions per business day beside Poisson and negative binomial of the measured mean."""
    expected = daily_count_share(daily, "observed", "mean").select(
        "regime",
        "sessions",
        "observed",
        dist.poisson(F.col("sessions"), F.col("mean")).alias("poisson"),
        dist.negative_binomial(F.col("sessions"), F.col("mean"), CUSTODY_DISPERSION).alias("negative_binomial"),
    )
    return _with_largest_gap(expected, "poisson")


def session_size_expected(sessions: DataFrame) -> DataFrame:
    """Requests per session beside the geometric of the measured mean."""
    expected = session_size_share(sessions, "observed", "mean").select(
        "regime", "events", "observed", dist.geometric(F.col("events"), F.col("mean")).alias("geometric")
    )
    return _with_largest_gap(expected, "geometric")


def gaps_expected(requests: DataFrame, operators: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Seconds between consecutive requests of a session beside the exponential of the measured mean.

    Bars have the round width nearest to a fifth of the mean, up to four means.
    """
    ordered = with_previous(
        requests.select(*by, "session_id", "operator_id", "timestamp", "event_id"),
        [*by, "session_id"],
        ["timestamp", "event_id"],
        "timestamp",
        "_previous",
    )
    seconds = (minutes_between(F.col("_previous"), F.col("timestamp")) * 60).alias("seconds")
    gaps = (
        ordered.where(F.col("_previous").isNotNull())
        .join(operators.select(*by, "operator_id", "regime"), [*by, "operator_id"])
        .select("regime", seconds)
    )
    micros = F.round(F.col("seconds") * 1e6).cast("bigint")
    means = gaps.groupBy("regime").agg((F.sum(micros) / F.count("*") / 1e6).alias("mean"), F.count("*").alias("_all"))
    target = F.lit(4.0) * F.col("mean") / GAP_BARS
    widths = F.array(*[F.lit(width) for width in gap_widths()])
    nearest = F.array_min(F.transform(widths, lambda width: F.struct(F.abs(width - target).alias("off"), width.alias("width"))))
    sized = means.withColumn("width", nearest["width"].cast("bigint"))
    placed = gaps.join(sized, "regime")
    bar = (F.floor(F.col("seconds") / F.col("width")) * F.col("width")).cast("bigint")
    counted = placed.groupBy("regime", bar.alias("from_second")).agg(F.count("*").alias("_n"))
    last_bar = (F.ceil(F.lit(4.0) * F.col("mean") / F.col("width")) - 1).cast("bigint")
    spine = integer_spine(sized, F.lit(0), last_bar, "_bar").withColumn(
        "from_second", F.col("_bar") * F.col("width")
    )
    expected = spine.join(counted, ["regime", "from_second"], "left").select(
        "regime",
        "from_second",
        "width",
        share(F.coalesce(F.col("_n"), F.lit(0)), F.col("_all")).alias("observed"),
        dist.exponential_bin(F.col("from_second"), F.col("width"), F.col("mean")).alias("exponential"),
    )
    return _with_largest_gap(expected, "exponential")


def _with_largest_gap(table: DataFrame, expected: str) -> DataFrame:
    """Axis tables are short: one row per point of the axis."""
    gap = F.abs(F.col("observed") - F.col(expected))
    return table.withColumn("largest_gap", F.max(gap).over(W.partitionBy("regime")))


def address_usage(sessions: DataFrame, operators: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Share of sessions by position of the source in the operator's address list beside its geometric weight."""
    listed = operators.select(
        *by,
        "operator_id",
        F.size("usual_ips").alias("_size"),
        F.posexplode("usual_ips").alias("_position", "source_ip"),
    )
    used = (
        sessions.groupBy(*by, "regime", "operator_id", "source_ip")
        .agg(F.count("*").alias("_n"))
        .join(listed, [*by, "operator_id", "source_ip"])
    )
    weight = dist.geometric_weight(F.col("_position"), F.col("_size"), PRIMARY_ADDRESS_SHARE)
    counted = used.groupBy("regime", (F.col("_position") + 1).cast("bigint").alias("position")).agg(
        F.sum("_n").alias("sessions"), F.avg(weight).alias("expected")
    )
    return counted.withColumn(
        "observed", share(F.col("sessions"), F.sum("sessions").over(W.partitionBy("regime")))
    )


def unseen_addresses(
    sources: DataFrame, windows: DataFrame, operators: DataFrame, by: Sequence[str] = ("seed",)
) -> DataFrame:
    """Usual addresses never seen in the warm-up, by position, beside the chance of that happening."""
    listed = operators.select(
        *by, "operator_id", F.size("usual_ips").alias("_size"), F.posexplode("usual_ips").alias("_position", "source_ip")
    )
    seen = sources.select(*by, "operator_id", "source_ip", F.lit(1).alias("_seen"))
    weight = dist.geometric_weight(F.col("_position"), F.col("_size"), PRIMARY_ADDRESS_SHARE)
    joined = (
        listed.join(windows.select(*by, "operator_id", "session_count"), [*by, "operator_id"])
        .join(seen, [*by, "operator_id", "source_ip"], "left")
        .select(
            (F.col("_position") + 1).cast("bigint").alias("position"),
            F.col("_seen").isNull().alias("_unseen"),
            dist.never_drawn(weight, F.col("session_count")).alias("_chance"),
        )
    )
    return joined.groupBy("position").agg(
        F.count("*").alias("operators"),
        share(F.count_if("_unseen"), F.count("*")).alias("never_seen"),
        F.avg("_chance").alias("expected_never_seen"),
    )


# --- rules ---------------------------------------------------------------------------------------------------------


def fired_distribution(predictions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Share of each class by number of rules fired, 0 to 8."""
    return shares_on_axis(
        predictions.select(*by, LABEL, F.col("rules_fired").cast("bigint").alias("rules_fired")),
        [*by, LABEL],
        "rules_fired",
        F.lit(0),
        F.lit(len(ATTRIBUTES)),
    )


def firing_rates(predictions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """How often each rule fires in each class, and the rule that fires most on attacks (the first of equals)."""
    legitimate, attack = F.col(LABEL) == 0, F.col(LABEL) == 1
    columns = []
    for name in RULE_COLUMNS:
        columns.append(share(F.sum(F.when(legitimate, F.col(name))), F.count_if(legitimate)).alias(f"legitimate_{name}"))
        columns.append(share(F.sum(F.when(attack, F.col(name))), F.count_if(attack)).alias(f"attack_{name}"))
    wide = predictions.groupBy(*by).agg(*columns)
    entries = [
        F.struct(
            F.lit(place).alias("place"),
            F.lit(attribute).alias("rule"),
            F.col(f"legitimate_{name}").alias("legitimate"),
            F.col(f"attack_{name}").alias("attack"),
        )
        for place, (attribute, name) in enumerate(zip(ATTRIBUTES, RULE_COLUMNS))
    ]
    top = W.partitionBy(*by).orderBy(F.col("attack").desc_nulls_last(), "place")
    return (
        wide.select(*by, F.inline(F.array(*entries)))
        .withColumn("is_most_fired", F.row_number().over(top) == 1)
        .drop("place")
    )


def cutoff_curve(predictions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """False-alarm rate and recall if 1, 2, ... 8 rules were asked for, all from one pass."""
    legitimate, attack = F.col(LABEL) == 0, F.col(LABEL) == 1
    columns = [F.count_if(legitimate).alias("_legitimate"), F.count_if(attack).alias("_attack")]
    cuts = range(1, len(ATTRIBUTES) + 1)
    for cut in cuts:
        enough = F.col("rules_fired") >= cut
        columns.append(F.count_if(legitimate & enough).alias(f"_l{cut}"))
        columns.append(F.count_if(attack & enough).alias(f"_a{cut}"))
    wide = predictions.groupBy(*by).agg(*columns)
    entries = [
        F.struct(
            F.lit(cut).cast("bigint").alias("cutoff"),
            share(F.col(f"_l{cut}"), F.col("_legitimate")).alias("false_alarm"),
            share(F.col(f"_a{cut}"), F.col("_attack")).alias("recall"),
        )
        for cut in cuts
    ]
    return wide.select(*by, F.inline(F.array(*entries)))


def class_sizes(predictions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    return predictions.groupBy(*by).agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col(LABEL) == 0).alias("legitimate"),
        F.count_if(F.col(LABEL) == 1).alias("attack"),
    )


def alert_counts(predictions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    return predictions.groupBy(*by).agg(F.sum("predicted").cast("bigint").alias("alerts"))


def confusion_report(predictions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Confusion and unrounded rates of a run in long form."""
    rated = confusion_counts(predictions, by).select("*", *rates.rate_columns(None))
    measures = [*rates.CELLS, *rates.RATES]
    return rated.select(*by, *[F.col(name).cast("double").alias(name) for name in measures]).unpivot(
        list(by), measures, "measure", "value"
    )


def rules_over_sigma(metrics: DataFrame) -> DataFrame:
    """Median F1, recall and specificity of the rules by condition."""
    of_rules = metrics.where((F.col("mechanism") == "rules") & (F.col("scope") == "all"))
    return of_rules.groupBy("sigma").agg(
        *[F.percentile(name, F.lit(0.5)).alias(f"median_{name}") for name in ("f1", "recall", "specificity")],
        F.count_distinct("seed").alias("seeds"),
    )


def threshold_spread(thresholds: DataFrame) -> DataFrame:
    """Each threshold over the replicas: count, median, range, coefficient of variation (NULL for one replica)."""
    value = F.col("threshold")
    return thresholds.groupBy("attribute").agg(
        F.count("*").alias("seeds"),
        half_even(F.percentile(value, F.lit(0.5))).alias("median"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("variation"),
    )


def threshold_histogram(
    sessions: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("seed",), counts: Sequence[str] = ("events", "distinct_keys")
) -> DataFrame:
    """Each magnitude attribute in bins, split at its threshold.

    Counts and constants get one bin per whole number around the values, anything else thirty equal bins, the last
    one closed on the right. Equal values are added up before they are binned.
    """
    key = [*by, "attribute"]
    values = (
        in_long_form(sessions, by, MAGNITUDE_ATTRIBUTES).groupBy(*key, "value").agg(F.count("*").alias("_n"))
    )
    spans = values.groupBy(*key).agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.sum("_n").alias("_all")
    )
    unit = F.col("attribute").isin(*counts) | (F.col("_low") == F.col("_high"))
    span = F.col("_high") - F.col("_low")
    shaped = (
        spans.join(thresholds.select(*key, "threshold"), key)
        .withColumn("_unit", unit)
        .withColumn("_bins", F.when(unit, F.floor(span) + 1).otherwise(F.lit(HISTOGRAM_BINS)).cast("bigint"))
        .withColumn("_width", F.when(unit, F.lit(1.0)).otherwise(span / F.lit(float(HISTOGRAM_BINS))))
        .withColumn("_start", F.when(unit, F.col("_low") - F.lit(0.5)).otherwise(F.col("_low")))
    )
    place = F.floor((F.col("value") - F.col("_start")) / F.col("_width"))
    binned = (
        values.join(shaped, key)
        .withColumn("bin", F.least(place, F.col("_bins") - 1))
        .groupBy(*key, "bin")
        .agg(
            F.sum(F.when(F.col("value") <= F.col("threshold"), F.col("_n")).otherwise(0)).alias("_up_to"),
            F.sum(F.when(F.col("value") > F.col("threshold"), F.col("_n")).otherwise(0)).alias("_above"),
        )
    )
    spine = integer_spine(shaped, F.lit(0), F.col("_bins") - 1, "bin")
    return spine.join(binned, [*key, "bin"], "left").select(
        *key,
        "bin",
        half_even(F.col("_start") + (F.col("bin") + F.lit(0.5)) * F.col("_width")).alias("centre"),
        share(F.coalesce(F.col("_up_to"), F.lit(0)), F.col("_all")).alias("up_to_threshold"),
        share(F.coalesce(F.col("_above"), F.lit(0)), F.col("_all")).alias("above_threshold"),
    )


def share_above_threshold(sessions: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Share of the clean warm-up that lies strictly above each threshold."""
    key = [*by, "attribute"]
    long = in_long_form(sessions, by, MAGNITUDE_ATTRIBUTES)
    joined = long.join(thresholds.select(*key, "threshold"), key)
    return joined.groupBy(*key).agg(
        share(F.count_if(F.col("value") > F.col("threshold")), F.count("*")).alias("above_threshold")
    )
