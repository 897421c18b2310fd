"""Every registered query: a name, and a function from the adapter to a DataFrame with plain columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyvigil.functions import rates
from keyvigil.functions.calendar import EVALUATED, WARMUP, clock, is_business_day, iso
from keyvigil.functions.rates import half_even
from keyvigil.functions.statistics import holm, signed_rank
from keyvigil.functions.text import identifier, join_cell, split_cell, verdict
from keyvigil.operators import (
    calibration,
    campaign,
    description,
    evaluation,
    grid_learning,
    importance,
    learning,
    ordering,
    partition,
    policy,
    quality,
    rules,
    sessions,
    stump,
)
from keyvigil.plans.pipeline import Pipeline
from keyvigil.schemas import ATTRIBUTES, IDENTIFIERS, LABEL, RULE_COLUMNS, RULES
from keyvigil.session import new_folder, written
from keyvigil.sources import tables
from keyvigil.sources.adapter import PERIOD, SIGMAS, STAND_INS, Adapter
from keyvigil.streaming import jobs

SEARCH_SIGMA = 0.5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

class Context(Adapter):
    """The adapter together with the audit job over it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.audit = Pipeline(self.log, self.compromised)
        # The same over every (seed, sigma).
        self.grid = Pipeline(self.grid_log, self.grid_compromised, run=("seed", "sigma"))
        # One consumer only: nothing is gained from storing the sessions.
        self.direct = Pipeline(self.log, self.compromised, store=False)

    @cached_property
    def metrics(self) -> DataFrame:
        return evaluation.run_metrics(self.predictions, self.administrators)

    @cached_property
    def stored_metrics(self) -> DataFrame:
        """The metric table as its later readers find it: stored, one row per cell of the grid."""
        return written(self.metrics, "metrics")

    @property
    def traffic(self) -> DataFrame:
        return description.traffic_sessions(self.requests, self.operators)

    @property
    def daily(self) -> DataFrame:
        return description.business_day_counts(self.traffic, self.operators, PERIOD)


def query(name: str) -> Callable[[Callable[[Context], DataFrame]], Callable[[Context], DataFrame]]:
    def register(build: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Context(spark, sf_dir))

        QUERIES[name] = run
        return build

    return register


def shown(table: DataFrame) -> DataFrame:
    """Session rows with the opening as ISO text."""
    return table.withColumn("opened_at", iso(F.col("opened_at")))


def six(name: str) -> F.Column:
    return half_even(F.col(name), 6).alias(name)


# --- A: sources and sinks ------------------------------------------------------------------------------------------


@query("a2_runs_of_grid")
def a2(c: Context) -> DataFrame:
    root = new_folder(c.spark, "grid")
    path = tables.write_table(c.predictions, root, "predictions", partitioned_by=tables.GRID)
    read = c.spark.read.schema(c.predictions.schema).parquet(path)
    return read.groupBy("seed", "sigma", "mechanism").agg(
        F.count("*").alias("sessions"), F.sum("predicted").cast("bigint").alias("alerts")
    )


@query("a1_operators_both_layouts")
def a1(c: Context) -> DataFrame:
    """The operator table through both layouts and back: rows that come back from CSV and from Parquet."""
    root = new_folder(c.spark, "layouts")
    table = c.operators.select("operator_id", "profile", "scopes", "regime", "usual_ips")
    read = []
    for layout in ("csv", "parquet"):
        tables.write_table(table, root, "operators", layout)
        read.append(tables.read_all(c.spark, root, ["operators"], layout)["operators"].withColumn("layout", F.lit(layout)))
    both = read[0].unionByName(read[1])
    return both.select("layout", "operator_id", "profile", "regime", F.array_join("usual_ips", "|").alias("usual_ips"),
                       F.array_join(F.array_sort("scopes"), "|").alias("scopes"))


@query("a2_one_run")
def a2_run(c: Context) -> DataFrame:
    """One condition of the stored grid: the filter on a folder name reads only its files."""
    root = new_folder(c.spark, "grid")
    tables.write_table(c.predictions, root, "predictions", partitioned_by=tables.GRID)
    read = c.spark.read.schema(c.predictions.schema).parquet(tables.table_path(root, "predictions"))
    return tables.of_run(read, 3, 0.5).select("session_id", "mechanism", "predicted")


@query("a4_runs_written_again")
def a4(c: Context) -> DataFrame:
    """The stored grid after one run was first written with inverted alerts and then again as it should be."""
    root = new_folder(c.spark, "grid")
    wrong = (F.col("seed") == 3) & (F.col("sigma") == 0.5)
    kind = c.predictions.schema["predicted"].dataType
    spoilt = F.when(wrong, (1 - F.col("predicted").cast("int")).cast(kind)).otherwise(F.col("predicted"))
    tables.write_runs(c.predictions.withColumn("predicted", spoilt), root, "predictions")
    path = tables.write_runs(c.predictions.where(wrong), root, "predictions")
    read = c.spark.read.schema(c.predictions.schema).parquet(path)
    counted = read.groupBy("seed", "sigma", "mechanism").agg(
        F.count("*").alias("sessions"), F.sum("predicted").cast("bigint").alias("alerts")
    )
    return counted.join(tables.committed_runs(c.spark, root, "predictions"), list(tables.GRID), "left")


@query("a5_runs_index")
def a5(c: Context) -> DataFrame:
    owners = (
        c.requests.join(c.compromised, ["seed", "session_id"], "left_semi")
        .groupBy("seed")
        .agg(F.min("operator_id").alias("compromised_admin"))
    )
    return tables.runs_index([owners.withColumn("sigma", F.lit(sigma)) for sigma in SIGMAS])


@query("a6_pooled_predictions")
def a6(c: Context) -> DataFrame:
    pooled = tables.pooled(c.predictions, 0.5)
    return pooled.groupBy("mechanism").agg(
        F.count("*").alias("sessions"),
        F.count_distinct("seed").alias("seeds"),
        F.sum("predicted").cast("bigint").alias("alerts"),
    )


@query("a7_thresholds_of_seeds")
def a7(c: Context) -> DataFrame:
    return tables.thresholds_of_seeds(c.audit.thresholds, range(1, 13))


@query("a8_missing_runs")
def a8(c: Context) -> DataFrame:
    return tables.missing_runs(c.predictions, range(1, 13), (0.0, 0.25, 0.5, 0.75, 1.0))


# --- B: projections and filters ------------------------------------------------------------------------------------


@query("b1_phase_counts")
def b1(c: Context) -> DataFrame:
    moment = F.col("timestamp")
    return c.requests.groupBy("seed").agg(
        F.count_if(PERIOD.belongs_to(WARMUP, moment)).alias("warmup"),
        F.count_if(PERIOD.belongs_to(EVALUATED, moment)).alias("evaluated"),
        F.count("*").alias("requests"),
    )


@query("b2_week_bounds")
def b2(c: Context) -> DataFrame:
    counted = c.requests.groupBy(PERIOD.week_of(F.col("timestamp")).alias("week")).agg(F.count("*").alias("requests"))
    return PERIOD.week_table(c.spark).join(counted, "week", "left").select(
        "week",
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
        F.date_format("day_after_last", "yyyy-MM-dd").alias("day_after_last"),
        F.coalesce("requests", F.lit(0)).alias("requests"),
    )


@query("b3_phase_slices")
def b3(c: Context) -> DataFrame:
    ruler = c.requests.where(PERIOD.belongs_to(WARMUP, F.col("timestamp"))).select("session_id", "key_id")
    evaluated = campaign.legitimate_of_evaluated(c.requests, PERIOD).select("session_id", "key_id")
    both = ruler.withColumn("slice", F.lit("warmup")).unionByName(evaluated.withColumn("slice", F.lit("evaluated")))
    return both.groupBy("slice").agg(F.count("*").alias("rows"), F.count_distinct("key_id").alias("keys"))


@query("b6_administrators")
def b6(c: Context) -> DataFrame:
    return c.administrators.select("seed", "operator_id", "regime").orderBy("operator_id")


@query("b7_filter_expression")
def b7(c: Context) -> DataFrame:
    return tables.kept_share(c.direct.warmup, "events > 4 AND failures_per_event > 0.2")


@query("b8_of_condition")
def b8(c: Context) -> DataFrame:
    chosen = tables.of_condition(c.metrics, 0.5, evaluation.ALL_SESSIONS)
    return tables.of_mechanisms(chosen, STAND_INS).select("seed", "mechanism", "sessions", "positives", "f1")


@query("b9_business_days")
def b9(c: Context) -> DataFrame:
    daily = c.requests.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("requests"))
    return daily.where(is_business_day(F.col("day"))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "requests")


@query("b10_day_spine")
def b10(c: Context) -> DataFrame:
    daily = c.requests.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("_n"))
    return PERIOD.day_spine(c.spark).join(daily, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("_n", F.lit(0)).alias("requests")
    )


@query("b11_slice_shares")
def b11(c: Context) -> DataFrame:
    return partition.side_shares(c.audit.split)


# --- C: joins ------------------------------------------------------------------------------------------------------


@query("c1_audit_log")
def c1(c: Context) -> DataFrame:
    log = policy.phase_log(c.requests, c.keys, c.grants, PERIOD, EVALUATED, ("seed",), ())
    return log.select(
        "event_id", "session_id", "operator_id", iso(F.col("timestamp")).alias("timestamp"), "source_ip", "operation",
        "key_id", "outcome",
    )


@query("c2_outcomes")
def c2(c: Context) -> DataFrame:
    decided = policy.outcomes(c.requests, c.keys, c.grants, ("seed",), ())
    return decided.select("event_id", "outcome")


@query("c3_unknown_operators")
def c3(c: Context) -> DataFrame:
    """Requests for an existing key that nobody of the end users' table could have made: the other profiles' ones."""
    users = c.operators.where(F.col("profile") == "end_user")
    return policy.unknown_operators(c.requests, users, c.keys, ("seed",), ()).select("event_id", "operator_id")


@query("b4_columns")
def b4(c: Context) -> DataFrame:
    """Columns of each phase's table in order, with how many of its cells are empty."""
    tables_ = {WARMUP: c.audit.warmup_sessions, EVALUATED: c.audit.evaluated}
    parts = []
    for phase, table in tables_.items():
        names = sessions.columns_of(phase)
        counts = table.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
        entries = [F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(n).alias("column"), F.col(n).alias("empty")) for i, n in enumerate(names)]
        parts.append(counts.select(F.lit(phase).alias("phase"), F.inline(F.array(*entries))))
    return parts[0].unionByName(parts[1])


@query("c4_history_attributes")
def c4(c: Context) -> DataFrame:
    return c.audit.evaluated.select("session_id", "operator_id", "atypical_hour", "new_source_ip")


@query("c5_labels")
def c5(c: Context) -> DataFrame:
    opened = sessions.openings(c.requests.where(PERIOD.belongs_to(EVALUATED, F.col("timestamp"))))
    return sessions.with_label(opened, c.compromised).select("session_id", LABEL)


@query("c6_duplicates")
def c6(c: Context) -> DataFrame:
    return partition.duplicates(c.audit.split)


@query("c7_same_sessions")
def c7(c: Context) -> DataFrame:
    ruled = c.predictions.where(F.col("mechanism") == RULES)
    modelled = c.predictions.where(F.col("mechanism") == STAND_INS[0])
    return evaluation.one_sided_sessions(ruled, modelled)


@query("c8_cutoffs")
def c8(c: Context) -> DataFrame:
    return calibration.cutoffs(c.direct.thresholds)


@query("c9_reach")
def c9(c: Context) -> DataFrame:
    return policy.reach_counts(c.grants, c.keys, ("seed",), ()).drop("seed")


@query("c9_keys_out_of_reach")
def c9_out(c: Context) -> DataFrame:
    return policy.out_of_reach(c.operators, c.keys)


@query("c9_scopes_out_of_reach")
def c9_scopes(c: Context) -> DataFrame:
    return policy.scopes_out_of_reach(c.operators, c.keys)


@query("c10_scope_holders")
def c10(c: Context) -> DataFrame:
    return policy.holders_by_scope(c.grants)


@query("c10_uncovered_scopes")
def c10_uncovered(c: Context) -> DataFrame:
    """Scopes of keys that somebody asked for and no operator of a profile holds, by profile."""
    held = c.operators.select("profile", F.explode("scopes").alias("scope")).groupBy("scope").agg(
        F.count_if(F.col("profile") == "administrator").alias("administrators"),
        F.count_if(F.col("profile") == "automated_service").alias("services"),
    )
    uncovered = policy.scopes_without_holder(c.keys, c.grants).withColumn("_bare", F.lit(1))
    return (
        c.keys.select("scope").distinct().join(held, "scope", "left").join(uncovered, "scope", "left")
        .select(
            "scope",
            F.coalesce("administrators", F.lit(0)).alias("administrators"),
            F.coalesce("services", F.lit(0)).alias("services"),
            F.col("_bare").isNotNull().cast("int").alias("uncovered"),
        )
    )


@query("c11_operator_attributes")
def c11(c: Context) -> DataFrame:
    return c.traffic.select(
        "session_id", "operator_id", "regime", "source_ip", F.col("from_primary").cast("int").alias("from_primary")
    )


# --- D: aggregations -----------------------------------------------------------------------------------------------


@query("d1_per_session")
def d1(c: Context) -> DataFrame:
    counted = shown(sessions.per_session(c.log.where(F.col("phase").isNotNull()), ("seed", "phase")))
    return counted.withColumn("closed_at", iso(F.col("closed_at")))


@query("d2_rate_attributes")
def d2(c: Context) -> DataFrame:
    rated = sessions.with_rates(sessions.per_session(c.log))
    return rated.select(
        "session_id", "duration_minutes", "requests_per_minute", "failures_per_event", "denials_per_event"
    )


@query("d3_sessions")
def d3(c: Context) -> DataFrame:
    return shown(c.audit.evaluated)


@query("d3_warmup_sessions")
def d3_warmup(c: Context) -> DataFrame:
    return shown(c.audit.warmup_sessions)


@query("d4_session_openings")
def d4(c: Context) -> DataFrame:
    return shown(sessions.openings(c.requests))


@query("d5_profiles")
def d5(c: Context) -> DataFrame:
    return c.audit.profiles.withColumn("observed_ips", join_cell(F.col("observed_ips")))


@query("d6_window_width")
def d6(c: Context) -> DataFrame:
    return sessions.window_width_hours(c.direct.windows).select("operator_id", six("width_hours"))


@query("d7_thresholds")
def d7(c: Context) -> DataFrame:
    return c.direct.thresholds


@query("d8_confusion")
def d8(c: Context) -> DataFrame:
    return evaluation.confusion_counts(c.predictions, ("seed", "sigma", "mechanism"))


@query("d9_rates")
def d9(c: Context) -> DataFrame:
    counted = evaluation.confusion_counts(c.predictions, ("seed", "sigma", "mechanism"))
    return counted.select("seed", "sigma", "mechanism", *rates.rate_columns())


@query("d10_roc_points")
def d10(c: Context) -> DataFrame:
    pooled = evaluation.confusion_counts(c.predictions, ("sigma", "mechanism"))
    return pooled.select("sigma", "mechanism", *rates.roc_point())


@query("d11_roc_auc")
def d11(c: Context) -> DataFrame:
    return evaluation.areas(c.predictions, ("seed", "sigma", "mechanism"))


@query("d12_negatives_per_positive")
def d12(c: Context) -> DataFrame:
    ruled = c.predictions.where((F.col("mechanism") == RULES) & (F.col("sigma") == 0.0))
    return ruled.groupBy("seed").agg(rates.negatives_per_positive(F.col(LABEL)).alias("negatives_per_positive"))


@query("d13_metrics")
def d13(c: Context) -> DataFrame:
    return c.metrics


@query("d14_partition_counts")
def d14(c: Context) -> DataFrame:
    return partition.side_counts(c.audit.split)


@query("d15_triviality")
def d15(c: Context) -> DataFrame:
    return evaluation.triviality(c.audit.split)


@query("d16_median_f1")
def d16(c: Context) -> DataFrame:
    return evaluation.median_f1(c.stored_metrics)


@query("d17_f1_summary")
def d17(c: Context) -> DataFrame:
    return evaluation.f1_summary(c.metrics).select("scope", "sigma", "mechanism", six("median"), six("q1"), six("q3"))


@query("d18_timing_summary")
def d18(c: Context) -> DataFrame:
    return evaluation.timing_summary(c.timings)


@query("d19_confusion_cells")
def d19(c: Context) -> DataFrame:
    return evaluation.confusion_cells(c.metrics)


@query("d19_grid_totals")
def d19_totals(c: Context) -> DataFrame:
    return evaluation.grid_totals(c.metrics)


@query("d20_confusion_report")
def d20(c: Context) -> DataFrame:
    return description.confusion_report(c.audit.alerts).select("seed", "measure", six("value"))


@query("d21_rules_fired")
def d21(c: Context) -> DataFrame:
    return description.fired_distribution(c.audit.alerts)


@query("d22_firing_rates")
def d22(c: Context) -> DataFrame:
    return description.firing_rates(c.audit.alerts).withColumn("is_most_fired", F.col("is_most_fired").cast("int"))


@query("d23_cutoff_curve")
def d23(c: Context) -> DataFrame:
    return description.cutoff_curve(c.audit.alerts)


@query("d24_rules_over_sigma")
def d24(c: Context) -> DataFrame:
    return description.rules_over_sigma(c.metrics).select(
        "sigma", six("median_f1"), six("median_recall"), six("median_specificity"), "seeds"
    )


@query("d25_threshold_spread")
def d25(c: Context) -> DataFrame:
    return description.threshold_spread(c.direct.thresholds).select(
        "attribute", "seeds", "median", "least", "greatest", six("variation")
    )


@query("d26_threshold_histogram")
def d26(c: Context) -> DataFrame:
    return description.threshold_histogram(c.audit.warmup, c.audit.thresholds)


@query("d26_share_above_threshold")
def d26_share(c: Context) -> DataFrame:
    return description.share_above_threshold(c.audit.warmup, c.audit.thresholds)


@query("d27_traffic_sessions")
def d27(c: Context) -> DataFrame:
    return shown(c.traffic).select(
        "session_id", "operator_id", "regime", "opened_at", iso(F.col("closed_at")).alias("closed_at"), "events",
        six("minutes"), "source_ip", F.col("from_primary").cast("int").alias("from_primary"),
    )


@query("d28_business_day_counts")
def d28(c: Context) -> DataFrame:
    return c.daily.select("operator_id", "regime", F.date_format("day", "yyyy-MM-dd").alias("day"), "sessions")


@query("d29_shares_on_axis")
def d29(c: Context) -> DataFrame:
    """Session sizes 1 to 5; longer sessions stay in the denominator."""
    return description.shares_on_axis(c.traffic, ["regime"], "events", F.lit(1), F.lit(5))


@query("d30_hour_share")
def d30(c: Context) -> DataFrame:
    return description.hour_share(c.traffic)


@query("d30_weekday_share")
def d30_weekday(c: Context) -> DataFrame:
    return description.weekday_share(c.traffic)


@query("d31_session_sizes")
def d31(c: Context) -> DataFrame:
    return description.session_size_share(c.traffic)


@query("d31_sessions_per_day")
def d31_daily(c: Context) -> DataFrame:
    return description.daily_count_share(c.daily)


@query("d32_operation_mix")
def d32(c: Context) -> DataFrame:
    mix = description.operation_mix(c.requests, c.operators)
    return mix.select("profile", "operation", "declared", six("measured"), six("largest_gap"))


@query("d33_regime_overview")
def d33(c: Context) -> DataFrame:
    return description.regime_overview(c.traffic, c.operators).select(
        "regime", "profile", "operators", "sessions", six("median_minutes")
    )


@query("d34_median_sessions")
def d34(c: Context) -> DataFrame:
    return description.median_sessions_per_operator(c.traffic, PERIOD)


@query("d35_dispersion_index")
def d35(c: Context) -> DataFrame:
    return description.dispersion_index(c.traffic).select("regime", "operator_days", six("dispersion"))


@query("d36_keys_per_scope")
def d36(c: Context) -> DataFrame:
    return policy.keys_per_scope(c.keys).orderBy(F.col("keys").desc(), "scope")


@query("d37_importance_medians")
def d37(c: Context) -> DataFrame:
    drops = importance.rule_importance(c.audit.holdout, c.audit.thresholds)
    return importance.median_drops(drops, [RULES]).select(
        "attribute", six(RULES), F.col("place").cast("bigint").alias("place")
    )


@query("d38_session_invariants")
def d38(c: Context) -> DataFrame:
    return quality.session_invariants(c.audit.evaluated, c.log.where(F.col("phase") == EVALUATED))


@query("d39_alert_counts")
def d39(c: Context) -> DataFrame:
    return description.alert_counts(c.audit.alerts)


@query("d40_rule_catalogue")
def d40(c: Context) -> DataFrame:
    return rules.rule_catalogue(c.direct.thresholds).withColumn("place", F.col("place").cast("bigint"))


@query("d41_class_sizes")
def d41(c: Context) -> DataFrame:
    return description.class_sizes(c.audit.holdout_alerts)


@query("d42_request_period")
def d42(c: Context) -> DataFrame:
    return quality.request_period_report(c.requests, c.operators, PERIOD)


# --- E: order-dependent operators ----------------------------------------------------------------------------------


@query("e1_stable_order")
def e1(c: Context) -> DataFrame:
    placed = partition.with_ties(partition.in_stable_order(c.audit.evaluated))
    return placed.select("seed", LABEL, "session_id", "position", "tie")


@query("e2_holdout_sizes")
def e2(c: Context) -> DataFrame:
    opened = sessions.openings(c.requests.where(PERIOD.belongs_to(EVALUATED, F.col("timestamp"))))
    return partition.holdout_sizes(sessions.with_label(opened, c.compromised))


@query("e3_holdout")
def e3(c: Context) -> DataFrame:
    return c.audit.split.select("seed", LABEL, "session_id", "position", "side")


@query("e4_event_numbers")
def e4(c: Context) -> DataFrame:
    return campaign.with_event_numbers(c.requests).select("seed", "event_id", "position", "event_number")


@query("e5_session_numbers")
def e5(c: Context) -> DataFrame:
    placed = campaign.with_event_numbers(c.requests)
    return campaign.session_numbers(placed).select("seed", "session_id", "session_number")


@query("e6_injected_sessions")
def e6(c: Context) -> DataFrame:
    traffic, labels = campaign.merged(c.legitimate, c.campaign)
    marked = labels.withColumn("_mark", F.lit(1))
    return (
        traffic.join(marked, ["seed", "session_number"], "left")
        .select("seed", "event_number", "session_number", "event_id", F.col("_mark").isNotNull().cast("int").alias(LABEL))
    )


def _fold_scores(c: Context) -> DataFrame:
    """Fold scores of the stand-in mechanisms: every condition is one configuration."""
    placed = partition.folds(
        c.predictions.where(F.col("mechanism") != RULES), ("sigma", "mechanism"), repeats=3
    )
    counted = placed.groupBy("mechanism", "sigma", "repeat", "fold").agg(
        *rates.confusion(F.col(LABEL), F.col("predicted"))
    )
    f1 = rates.rates(*(F.col(cell) for cell in rates.CELLS))["f1"]
    return counted.select(
        F.col("mechanism").alias("model"),
        (F.col("sigma") * 2).cast("int").alias("position"),
        F.concat(F.lit("sigma="), F.col("sigma").cast("string")).alias("parameters"),
        "repeat",
        "fold",
        F.coalesce(f1, F.lit(0.0)).alias("f1"),
    )


@query("e7_chosen_configuration")
def e7(c: Context) -> DataFrame:
    scores = learning.configuration_scores(_fold_scores(c))
    return evaluation.chosen_configuration(scores).select("model", "position", "mean_f1", "std_f1")


@query("e8_most_important")
def e8(c: Context) -> DataFrame:
    drops = importance.rule_importance(c.audit.holdout, c.audit.thresholds)
    return importance.most_important(drops).select("mechanism", "attribute", six("median_drop"))


@query("e9_roc_curve")
def e9(c: Context) -> DataFrame:
    curve = evaluation.roc_curve(c.predictions, ("sigma", "mechanism"))
    score = half_even(F.col("score"), 9).alias("score")
    return curve.select("sigma", "mechanism", score, "false_positive_rate", "true_positive_rate")


@query("e10_stump")
def e10(c: Context) -> DataFrame:
    return stump.decision_stump(c.audit.split)


@query("e11_signed_rank")
def e11(c: Context) -> DataFrame:
    tested = signed_rank(evaluation.paired_differences(c.stored_metrics, STAND_INS), ("sigma", "model"), "difference")
    return tested.select("sigma", "model", "pairs", "statistic", six("p_value"))


@query("e12_holm")
def e12(c: Context) -> DataFrame:
    tested = signed_rank(evaluation.paired_differences(c.stored_metrics, STAND_INS), ("sigma", "model"), "difference")
    rounded = tested.select("sigma", "model", six("p_value"))
    corrected = holm(rounded, F.col("p_value").isNotNull(), "p_value", "p_holm", ("sigma", "model"))
    return corrected.select("sigma", "model", "p_value", six("p_holm"))


@query("e13_sample_quotas")
def e13(c: Context) -> DataFrame:
    strata = c.log.groupBy("seed", "outcome").agg(F.count("*").alias("requests"))
    return ordering.largest_remainder(strata, ["seed"], "outcome", "requests", 100)


# --- F: sorts and set operations -----------------------------------------------------------------------------------


@query("f1_sorted_operators")
def f1(c: Context) -> DataFrame:
    return ordering.numbered(c.operators.select("seed", "operator_id"), ["seed"], ["operator_id"], "place")


@query("f2_top_mechanism")
def f2(c: Context) -> DataFrame:
    best = W.partitionBy("sigma", "scope").orderBy(F.col("median_f1").desc_nulls_last(), "mechanism")
    return (
        evaluation.median_f1(c.stored_metrics)
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .select("sigma", "scope", "mechanism", "median_f1")
    )


@query("f3_shuffled_rows")
def f3(c: Context) -> DataFrame:
    opened = sessions.openings(c.requests).select("seed", "session_id")
    drawn = opened.withColumn("_draw", ordering.hash_order(F.col("seed"), F.col("session_id")))
    return ordering.ranked_by_hash(drawn, ["seed"], "_draw", "place", ties=("session_id",)).drop("_draw")


@query("f4_stacked_sides")
def f4(c: Context) -> DataFrame:
    both = c.audit.train.withColumn("side", F.lit("train")).unionByName(
        c.audit.holdout.withColumn("side", F.lit("holdout"))
    )
    return both.groupBy("seed", "side").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("f5_operators_of_both_phases")
def f5(c: Context) -> DataFrame:
    moment = F.col("timestamp")
    before = c.requests.where(PERIOD.belongs_to(WARMUP, moment)).select("operator_id").distinct()
    after = c.requests.where(PERIOD.belongs_to(EVALUATED, moment)).select("operator_id").distinct()
    return before.join(after, "operator_id", "left_semi")


@query("f6_keys_not_evaluated")
def f6(c: Context) -> DataFrame:
    """Pairs an operator asked for in the warm-up and never again."""
    moment = F.col("timestamp")
    before = c.requests.where(PERIOD.belongs_to(WARMUP, moment)).select("operator_id", "key_id").distinct()
    after = c.requests.where(PERIOD.belongs_to(EVALUATED, moment)).select("operator_id", "key_id").distinct()
    return before.join(after, ["operator_id", "key_id"], "left_anti")


@query("f7_threshold_set")
def f7(c: Context) -> DataFrame:
    found = calibration.threshold_set_differences(c.direct.thresholds)
    return found.agg(
        F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "foreign").alias("foreign")
    )


@query("f8_novel_addresses")
def f8(c: Context) -> DataFrame:
    """Addresses of the evaluated phase that nobody used in the warm-up."""
    moment = F.col("timestamp")
    before = c.requests.where(PERIOD.belongs_to(WARMUP, moment)).select("source_ip").distinct()
    after = c.requests.where(PERIOD.belongs_to(EVALUATED, moment)).select("source_ip").distinct()
    return after.join(before, "source_ip", "left_anti")


@query("f8_foreign_addresses")
def f8_foreign(c: Context) -> DataFrame:
    novel = policy.novel_addresses(c.requests, c.operators).agg(F.count("*").alias("foreign_addresses"))
    known = c.operators.select(F.explode("usual_ips").alias("source_ip")).agg(
        F.count_distinct("source_ip").alias("known_addresses")
    )
    return known.withColumn("foreign_addresses", novel.scalar())


# --- G: scalar functions -------------------------------------------------------------------------------------------


@query("g1_multivalue_cells")
def g1(c: Context) -> DataFrame:
    joined = c.operators.select("operator_id", F.array_join("usual_ips", "|").alias("_cell"))
    cells = F.concat_ws("|", F.reverse(split_cell(F.col("_cell"))), F.col("_cell"))
    return joined.select("operator_id", join_cell(split_cell(cells)).alias("cell"))


@query("g2_clock_and_iso")
def g2(c: Context) -> DataFrame:
    moment = F.col("timestamp")
    return c.requests.select("event_id", clock(moment).alias("clock"), iso(moment).alias("iso"))


@query("g3_identifiers")
def g3(c: Context) -> DataFrame:
    return c.numbered_events.select(
        "event_id",
        identifier("event", F.col("event_id"), 6).alias("wide"),
        identifier("event", F.col("event_id"), 2).alias("narrow"),
    )


@query("g4_daily_counts_expected")
def g4(c: Context) -> DataFrame:
    table = description.daily_counts_expected(c.daily)
    return table.select(
        "regime", "sessions", six("observed"), six("poisson"), six("negative_binomial"), six("largest_gap")
    )


@query("g4_session_sizes_expected")
def g4_sizes(c: Context) -> DataFrame:
    table = description.session_size_expected(c.traffic)
    return table.select("regime", "events", six("observed"), six("geometric"), six("largest_gap"))


@query("g4_gaps_expected")
def g4_gaps(c: Context) -> DataFrame:
    table = description.gaps_expected(c.requests, c.operators)
    return table.select("regime", "from_second", "width", six("observed"), six("exponential"), six("largest_gap"))


@query("g5_address_usage")
def g5(c: Context) -> DataFrame:
    table = description.address_usage(c.traffic, c.operators)
    return table.select("regime", "position", "sessions", six("observed"), six("expected"))


@query("g5_unseen_addresses")
def g5_unseen(c: Context) -> DataFrame:
    table = description.unseen_addresses(c.audit.sources, c.audit.windows, c.operators)
    return table.select("position", "operators", six("never_seen"), six("expected_never_seen"))


@query("g6_verdicts")
def g6(c: Context) -> DataFrame:
    compared = _comparison(c)
    return compared.select("sigma", "model", verdict(F.col("excluded"), F.col("significant")).alias("verdict"))


# --- H: scoring, learning, evaluation ------------------------------------------------------------------------------


@query("h1_fired_rules")
def h1(c: Context) -> DataFrame:
    return c.audit.alerts.select("session_id", *RULE_COLUMNS)


@query("h2_decisions")
def h2(c: Context) -> DataFrame:
    return c.audit.alerts.select("session_id", "rules_fired", "predicted")


@query("h3_rule_alerts")
def h3(c: Context) -> DataFrame:
    return shown(c.audit.alerts)


@query("h3_grid_alerts")
def h3_grid(c: Context) -> DataFrame:
    """Alerts of every run: thresholds and profiles of the seed, sessions and labels of (seed, sigma)."""
    return shown(c.grid.alerts).select("seed", "sigma", "session_id", "opened_at", *RULE_COLUMNS, "rules_fired", "predicted", LABEL)


@query("e3_grid_holdout")
def e3_grid(c: Context) -> DataFrame:
    return c.grid.split.select("seed", "sigma", LABEL, "session_id", "position", "side")


@query("h1_cells_add_up")
def h1_cells(c: Context) -> DataFrame:
    """Sessions of each run, and how many of them a cell of the confusion table counts: the same."""
    sessions_of = c.grid.evaluated.groupBy("seed", "sigma").agg(F.count("*").alias("sessions"))
    cells = evaluation.confusion_counts(c.grid.alerts, ("seed", "sigma"))
    counted = sum((F.col(cell) for cell in rates.CELLS[1:]), F.col(rates.CELLS[0]))
    return sessions_of.join(cells.select("seed", "sigma", counted.alias("in_cells")), ["seed", "sigma"], "left")


@query("b5_guards")
def b5(c: Context) -> DataFrame:
    """What the guards of the audit job look at, as counts: all must be 0 for the job to be whole."""
    found = {
        "operators_without_profile": sessions.operators_without_profile(c.audit.evaluated, c.audit.windows).select("operator_id"),
        "replicas_without_thresholds": calibration.replicas_without_thresholds(c.audit.evaluated, c.audit.thresholds),
        "wrong_thresholds": calibration.threshold_set_differences(c.audit.thresholds),
        "unknown_operators": policy.unknown_operators(c.requests, c.operators, c.keys, ("seed",), ()),
    }
    rows = [t.agg(F.count("*").alias("violations")).select(F.lit(n).alias("guard"), "violations") for n, t in found.items()]
    return reduce(DataFrame.unionByName, rows)


@query("h3_holdout_alerts")
def h3_holdout(c: Context) -> DataFrame:
    return shown(c.audit.holdout_alerts)


def _models(c: Context, *names: str) -> DataFrame:
    """Held-out decisions of every (seed, sigma) by the named models with a point of the published grid."""
    return shown(grid_learning.grid_predictions(c.grid.split, {n: grid_learning.CONFIGURATION[n] for n in names}))


@query("h4_random_forest")
def h4(c: Context) -> DataFrame:
    return _models(c, learning.FOREST)


@query("h5_boosted_trees")
def h5(c: Context) -> DataFrame:
    return _models(c, learning.BOOSTING)


@query("h6_class_weights")
def h6(c: Context) -> DataFrame:
    weights = learning.class_weights(c.audit.train, ("seed",))
    return weights.select("seed", six("forest_positive"), six("forest_negative"), six("boosting_positive"))


@query("h7_folds")
def h7(c: Context) -> DataFrame:
    placed = partition.folds(c.audit.train)
    return placed.select("seed", LABEL, "session_id", "repeat", "fold")


def _search(c: Context) -> DataFrame:
    """Mean and deviation of all 168 configurations over 15 folds, on the training side of one run: first seed, sigma 0.5."""
    train = c.grid.train.where(F.col("sigma") == SEARCH_SIGMA)
    train = train.where(F.col("seed") == train.agg(F.min("seed")).scalar()).drop("seed", "sigma")
    return learning.configuration_scores(grid_learning.search_scores(train))


@query("h8_search")
def h8(c: Context) -> DataFrame:
    return _search(c)


@query("h8_fold_aggregate")
def h8_aggregate(c: Context) -> DataFrame:
    return learning.configuration_scores(_fold_scores(c)).select("model", "position", "mean_f1", "std_f1")


def _metrics_of_models(c: Context, decided: DataFrame) -> DataFrame:
    """The models beside the rules on every holdout, measured by the same metrics. Predictions have a folder per run."""
    root = new_folder(c.spark, "grid")
    path = tables.write_table(decided, root, "model_predictions", partitioned_by=tables.GRID)
    read = c.spark.read.schema(decided.schema).parquet(path)
    long = evaluation.in_mechanisms(c.grid.holdout_alerts, read, learning.MODELS)
    return evaluation.run_metrics(long, c.administrators)


@query("h10_models")
def h10(c: Context) -> DataFrame:
    """Both models trained for and decided on every (seed, sigma)."""
    return _metrics_of_models(c, grid_learning.grid_predictions(c.grid.split))


@query("h10_chosen_models")
def h10_chosen(c: Context) -> DataFrame:
    """From the search to the metrics: the chosen configuration is written, read back as text, and trained with."""
    root = new_folder(c.spark, "configuration")
    chosen = learning.configuration_table(_search(c))
    read = tables.read_text_table(c.spark, tables.write_table(chosen, root, "configuration", layout="csv"))
    return _metrics_of_models(c, grid_learning.grid_predictions(c.grid.split, learning.configuration_of(read)))


@query("a3_configuration")
def a3(c: Context) -> DataFrame:
    """The chosen configuration of the stand-ins through its CSV file, each value with its kind."""
    root = new_folder(c.spark, "configuration")
    chosen = learning.configuration_table(learning.configuration_scores(_fold_scores(c)))
    read = tables.read_text_table(c.spark, tables.write_table(chosen, root, "configuration", layout="csv"))
    return learning.typed_configuration(read)


@query("h9_grid_of_search")
def h9(c: Context) -> DataFrame:
    """Grid points that the fold table of the stand-ins has scores for, with the number of folds of each."""
    return _fold_scores(c).groupBy("model", "position", "parameters").agg(F.count("*").alias("folds"))


@query("h11_permutations")
def h11(c: Context) -> DataFrame:
    placed = importance.in_file_order(
        c.audit.holdout.select("seed", "session_id")
    )
    moved = importance.shuffled_values(placed, ["position"] * len(ATTRIBUTES))
    return moved.withColumnRenamed("swapped", "from_position")


@query("h12_rule_importance")
def h12(c: Context) -> DataFrame:
    return importance.rule_importance(c.audit.holdout, c.audit.thresholds)


@query("h12_model_importance")
def h12_models(c: Context) -> DataFrame:
    """The three mechanisms of every (seed, sigma): the rules with their thresholds, both models trained anew."""
    rules_lost = importance.rule_importance(c.grid.holdout, c.grid.thresholds, by=grid_learning.RUN)
    return grid_learning.grid_importance(c.grid.split).select(*rules_lost.columns).unionByName(rules_lost)


@query("h12_forest_importance")
def h12_forest(c: Context) -> DataFrame:
    configuration = {learning.FOREST: grid_learning.CONFIGURATION[learning.FOREST]}
    return grid_learning.grid_importance(c.audit.split, configuration, by=("seed",))


@query("h13_paired_differences")
def h13(c: Context) -> DataFrame:
    return evaluation.paired_differences(c.stored_metrics, STAND_INS).select("seed", "sigma", "model", six("difference"))


def _run_splits(c: Context) -> DataFrame:
    """The split of each replica as a run of every condition (the test log has one campaign for all)."""
    return c.audit.split.withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in SIGMAS])))


def _comparison(c: Context) -> DataFrame:
    cuts = written(stump.decision_stump(c.audit.split), "stumps").withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in SIGMAS])))
    return evaluation.comparison(c.stored_metrics, cuts, STAND_INS)


@query("h14_comparison")
def h14(c: Context) -> DataFrame:
    return _comparison(c).withColumns(
        {"excluded": F.col("excluded").cast("int"), "significant": F.col("significant").cast("int")}
    )


@query("h14_model_comparison")
def h14_models(c: Context) -> DataFrame:
    """The comparison on trained models instead of the stand-ins, with the one-cut tree of every run."""
    metrics = written(_metrics_of_models(c, grid_learning.grid_predictions(c.grid.split)), "metrics")
    cuts = written(stump.decision_stump(c.grid.split, grid_learning.RUN), "stumps")
    return evaluation.comparison(metrics, cuts, learning.MODELS).withColumns(
        {"excluded": F.col("excluded").cast("int"), "significant": F.col("significant").cast("int")}
    )


@query("h15_evaluation")
def h15(c: Context) -> DataFrame:
    """The four result tables of the whole grid, as one long summary of their measures."""
    found = evaluation.evaluation(c.predictions, c.administrators, _run_splits(c), c.timings, STAND_INS)
    parts = [
        found.metrics.agg(F.count("*").alias("rows"), F.sum("true_positives").alias("total")),
        found.triviality.agg(F.count("*").alias("rows"), F.sum("holdout_sessions").alias("total")),
        found.comparison.agg(F.count("*").alias("rows"), F.sum("seeds").alias("total")),
        found.timing.agg(F.count("*").alias("rows"), F.sum("runs").alias("total")),
    ]
    names = ("metrics", "triviality", "comparison", "timing")
    named = [part.withColumn("result", F.lit(name)) for name, part in zip(names, parts)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


# --- S: streaming --------------------------------------------------------------------------------------------------


def _streamed_log(c: Context, closing: bool) -> DataFrame:
    folder = jobs.stage(c.requests, "requests", closing)
    stream = jobs.request_stream(c.spark, folder, c.requests.schema)
    return jobs.streaming_decisions(stream, c.keys, c.grants, ("seed",), ())


@query("s1_streaming_outcomes")
def s1(c: Context) -> DataFrame:
    return jobs.run_available(_streamed_log(c, closing=False).select("event_id", "outcome"), "s1")


@query("s2_streaming_sessions")
def s2(c: Context) -> DataFrame:
    closed = jobs.run_available(jobs.streaming_sessions(_streamed_log(c, closing=True)), "s2")
    return shown(closed).select("seed", "session_id", "operator_id", "opened_at", *ATTRIBUTES[:6])


def _redelivered(c: Context, closing: bool) -> DataFrame:
    """The log of a stream that delivers every request twice."""
    twice = c.requests.unionByName(c.requests)
    stream = jobs.request_stream(c.spark, jobs.stage(twice, "redelivered", closing), c.requests.schema)
    return jobs.streaming_decisions(jobs.without_repeats(stream), c.keys, c.grants, ("seed",), ())


@query("s1_redelivered_outcomes")
def s1_again(c: Context) -> DataFrame:
    return jobs.run_available(_redelivered(c, closing=False).select("event_id", "outcome"), "s1-again")


@query("s2_redelivered_sessions")
def s2_again(c: Context) -> DataFrame:
    closed = jobs.run_available(jobs.streaming_sessions(_redelivered(c, closing=True)), "s2-again")
    return shown(closed).select("seed", "session_id", "operator_id", "opened_at", *ATTRIBUTES[:6])


@query("s3_streaming_alerts")
def s3(c: Context) -> DataFrame:
    frozen = c.audit
    live = jobs.streaming_sessions(_streamed_log(c, closing=True))
    alerts = jobs.streaming_alerts(live, frozen.windows, frozen.sources, frozen.thresholds)
    kept = alerts.select("seed", *IDENTIFIERS, *RULE_COLUMNS, "rules_fired", "predicted")
    return shown(jobs.run_available(kept, "s3"))
