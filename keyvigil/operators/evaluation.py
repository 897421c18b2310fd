"""Metrics of every run, the triviality check, the comparison and the time summary."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyvigil.functions import rates
from keyvigil.functions.rates import CELLS, half_even, share
from keyvigil.functions.statistics import holm, signed_rank
from keyvigil.operators.ordering import quantiles, running_totals
from keyvigil.operators.partition import duplicates, side_counts
from keyvigil.operators.stump import decision_stump
from keyvigil.schemas import (
    ADMINISTRATORS,
    ALL_SESSIONS,
    LABEL,
    RULES,
    SIGNIFICANCE_LEVEL,
    STUMP_MEDIAN_F1_CUTOFF,
)
from keyvigil.session import written

RUN = ("seed", "sigma")
GRID_CELL = ("seed", "sigma", "mechanism", "scope")
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def in_scopes(predictions: DataFrame, administrators: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each prediction once in scope `all`, and again in `administrators` when it is one of theirs."""
    marks = administrators.select(*by, "operator_id").distinct().withColumn("_admin", F.lit(True))
    both = F.array(F.lit(ALL_SESSIONS), F.lit(ADMINISTRATORS))
    scopes = F.when(F.col("_admin"), both).otherwise(F.array(F.lit(ALL_SESSIONS)))
    return predictions.join(marks, [*by, "operator_id"], "left").withColumn("scope", F.explode(scopes)).drop("_admin")


def in_mechanisms(rules: DataFrame, models: DataFrame, names: Sequence[str], by: Sequence[str] = RUN) -> DataFrame:
    """One row per (session, mechanism) from the wide prediction tables. The rules have no score."""
    from_rules = rules.select(
        *by, "session_id", "operator_id", LABEL, F.lit(RULES).alias("mechanism"), "predicted",
        F.lit(None).cast("double").alias("score"),
    )
    entries = [
        F.struct(F.lit(name).alias("mechanism"), F.col(name).alias("predicted"), F.col(f"{name}_score").alias("score"))
        for name in names
    ]
    from_models = models.select(*by, "session_id", "operator_id", LABEL, F.inline(F.array(*entries)))
    return from_rules.unionByName(from_models)


def one_sided_sessions(rules: DataFrame, models: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Per run, sessions that only one of two prediction tables covers; every count must be 0."""
    left = rules.select(*by, "session_id").withColumn("_left", F.lit(1))
    right = models.select(*by, "session_id").withColumn("_right", F.lit(1))
    return (
        left.join(right, [*by, "session_id"], "full_outer")
        .groupBy(*by)
        .agg(
            F.count_if(F.col("_right").isNull()).alias("only_first"),
            F.count_if(F.col("_left").isNull()).alias("only_second"),
        )
    )


def require_same_sessions(rules: DataFrame, models: DataFrame, by: Sequence[str] = RUN) -> None:
    found = one_sided_sessions(rules, models, by).where("only_first > 0 OR only_second > 0").take(1)
    if found:
        raise ValueError(f"predictions of different sessions in run {found[0].asDict()}")


def confusion_counts(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(*rates.confusion(F.col(LABEL), F.col("predicted")))


def score_counts(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sizes and confusion at each distinct score. Every rate and everything about ROC follows from this small table."""
    return predictions.groupBy(*by, "score").agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col(LABEL) == 1).alias("positives"),
        F.count_if(F.col(LABEL) == 0).alias("negatives"),
        *rates.confusion(F.col(LABEL), F.col("predicted")),
    )


def areas_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC AUC as the rank statistic: a positive beats the negatives below it and half of those at its own score."""
    known = counts.where(F.col("score").isNotNull()).select(*by, "score", "positives", "negatives")
    placed = running_totals(known, by, "score", ["positives", "negatives"])
    wins = F.sum(F.col("positives") * (F.col("negatives_before") + F.col("negatives") / F.lit(2.0)))
    pairs = F.max("positives_total").cast("double") * F.max("negatives_total").cast("double")
    return placed.groupBy(*by).agg(half_even(F.try_divide(wins, pairs)).alias("roc_auc"))


def areas(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    return areas_of(written(score_counts(predictions, by), "score-counts"), by)


def roc_curve(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(FPR, TPR) at each distinct score from the highest down, with the origin as the point above every score."""
    counts = score_counts(predictions.where(F.col("score").isNotNull()), by)
    known = written(counts.select(*by, "score", "positives", "negatives"), "score-counts")
    placed = running_totals(known, by, "score", ["positives", "negatives"], descending=True)
    points = placed.select(
        *by,
        "score",
        share(F.col("negatives_before") + F.col("negatives"), F.col("negatives_total")).alias("false_positive_rate"),
        share(F.col("positives_before") + F.col("positives"), F.col("positives_total")).alias("true_positive_rate"),
    )
    origin = known.select(*by).distinct().select(
        *by,
        F.lit(None).cast("double").alias("score"),
        F.lit(0.0).alias("false_positive_rate"),
        F.lit(0.0).alias("true_positive_rate"),
    )
    return points.unionByName(origin)


def run_metrics(
    predictions: DataFrame, administrators: DataFrame, by: Sequence[str] = GRID_CELL, replica: Sequence[str] = ("seed",)
) -> DataFrame:
    """One row per run, mechanism and scope: sizes, confusion, rounded rates and the AUC.

    The predictions are read once, down to counts per score; that table is stored and gives both the confusion and
    the AUC.
    """
    counts = written(score_counts(in_scopes(predictions, administrators, replica), by), "score-counts")
    counted = counts.groupBy(*by).agg(*[F.sum(name).alias(name) for name in ("sessions", "positives", *CELLS)])
    rated = counted.select("*", *rates.rate_columns())
    return rated.join(areas_of(counts, by), list(by), "left")


def triviality(split_table: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Sizes of both sides, the best single cut, and what both sides share: one row per run."""
    return (
        side_counts(split_table, by)
        .join(decision_stump(split_table, by), list(by))
        .join(duplicates(split_table, by), list(by))
    )


def median_f1(metrics: DataFrame) -> DataFrame:
    """Median over replicas of the rounded F1, per condition, scope and mechanism."""
    return metrics.groupBy("sigma", "scope", "mechanism").agg(
        half_even(F.percentile("f1", F.lit(0.5))).alias("median_f1"), F.count("f1").alias("seeds")
    )


def f1_summary(metrics: DataFrame) -> DataFrame:
    """Median and quartiles over replicas. The metric table has one row per grid cell, so it is small."""
    return metrics.groupBy("scope", "sigma", "mechanism").agg(
        F.percentile("f1", F.lit(0.5)).alias("median"),
        F.percentile("f1", F.lit(0.25)).alias("q1"),
        F.percentile("f1", F.lit(0.75)).alias("q3"),
    )


def paired_differences(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """F1 of a model minus F1 of the rules, replica by replica; a replica without either is left out."""
    wide = (
        metrics.where(F.col("scope") == ALL_SESSIONS)
        .groupBy(*RUN)
        .pivot("mechanism", [RULES, *models])
        .agg(F.first("f1"))
    )
    entries = [
        F.struct(F.lit(name).alias("model"), (F.col(name) - F.col(RULES)).alias("difference")) for name in models
    ]
    return wide.select(*RUN, F.inline(F.array(*entries))).where(F.col("difference").isNotNull())


def with_holm(rows: DataFrame) -> DataFrame:
    """Step-down correction over the kept conditions only; excluded ones get no corrected p."""
    corrected = holm(rows, F.col("p_value").isNotNull() & ~F.col("excluded"), "p_value", "_p", ("sigma", "model"))
    return corrected.select(
        "*",
        half_even(F.col("_p"), 6).alias("p_holm"),
        F.coalesce(F.col("_p") < SIGNIFICANCE_LEVEL, F.lit(False)).alias("significant"),
    ).drop("_p")


def comparison(metrics: DataFrame, stumps: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per condition and model: paired F1 difference, test, exclusion and corrected p.

    Both inputs have one row per cell or run of the grid and are read several times: hand over stored tables.
    """
    differences = paired_differences(metrics, models)
    spread = differences.groupBy("sigma", "model").agg(
        F.count("*").alias("seeds"),
        half_even(F.percentile("difference", F.lit(0.5))).alias("median_difference"),
        half_even(F.percentile("difference", F.lit(0.25))).alias("q1_difference"),
        half_even(F.percentile("difference", F.lit(0.75))).alias("q3_difference"),
    )
    tested = signed_rank(differences, ("sigma", "model"), "difference").select(
        "sigma", "model", "statistic", half_even(F.col("p_value"), 6).alias("p_value")
    )
    medians = median_f1(metrics)

    def medians_of(scope: str, name: str) -> DataFrame:
        return medians.where(F.col("scope") == scope).select(
            "sigma", F.col("mechanism").alias("model"), F.col("median_f1").alias(name)
        )

    def rules_of(scope: str, name: str) -> DataFrame:
        return medians_of(scope, name).where(F.col("model") == RULES).drop("model")

    stump_medians = stumps.groupBy("sigma").agg(F.percentile("stump_f1", F.lit(0.5)).alias("_stump"))
    rows = (
        spread.join(tested, ["sigma", "model"])
        .join(medians_of(ALL_SESSIONS, "median_f1_model"), ["sigma", "model"], "left")
        .join(rules_of(ALL_SESSIONS, "median_f1_rules"), "sigma", "left")
        .join(medians_of(ADMINISTRATORS, "median_f1_model_administrators"), ["sigma", "model"], "left")
        .join(rules_of(ADMINISTRATORS, "median_f1_rules_administrators"), "sigma", "left")
        .join(stump_medians, "sigma", "left")
        .withColumn("stump_median_f1", half_even(F.col("_stump")))
        .withColumn("excluded", F.coalesce(F.col("_stump") >= STUMP_MEDIAN_F1_CUTOFF, F.lit(False)))
        .drop("_stump")
    )
    return with_holm(rows)


def timing_rows(timings: DataFrame) -> DataFrame:
    """Both derived units of a measured decision time."""
    nanoseconds, sessions = F.col("median_nanoseconds"), F.col("sessions")
    return timings.select(
        "*",
        half_even(nanoseconds / sessions / F.lit(1.0e3)).alias("microseconds_per_session"),
        half_even(sessions * F.lit(1.0e9) / nanoseconds, 1).alias("sessions_per_second"),
    )


def timing_summary(timings: DataFrame) -> DataFrame:
    """Runs, median and quartiles of the time per session, median throughput, per mechanism."""
    spread = quantiles(timings, ["mechanism"], "microseconds_per_session", QUARTILES, count="runs")
    pace = quantiles(timings, ["mechanism"], "sessions_per_second", {"median": 0.5}, count="_runs")
    return spread.join(pace.select("mechanism", F.col("median").alias("_pace")), "mechanism").select(
        "mechanism",
        "runs",
        half_even(F.col("median")).alias("median_microseconds"),
        half_even(F.col("q1")).alias("q1_microseconds"),
        half_even(F.col("q3")).alias("q3_microseconds"),
        half_even(F.col("_pace"), 1).alias("median_sessions_per_second"),
    )


class Evaluation(NamedTuple):
    metrics: DataFrame
    triviality: DataFrame
    comparison: DataFrame
    timing: DataFrame


def evaluation(
    predictions: DataFrame,
    administrators: DataFrame,
    split_table: DataFrame,
    timings: DataFrame,
    models: Sequence[str],
) -> Evaluation:
    """All runs of the grid to the four result tables; `seed` and `sigma` are columns, so there is no loop."""
    metrics = written(run_metrics(predictions, administrators), "metrics")
    trivial = written(triviality(split_table, RUN), "triviality")
    return Evaluation(metrics, trivial, comparison(metrics, trivial, models), timing_summary(timings))


def chosen_configuration(scores: DataFrame) -> DataFrame:
    """Best configuration of each model: highest mean F1, then least spread, then first in the grid."""
    best = W.partitionBy("model").orderBy(F.col("mean_f1").desc(), F.col("std_f1").asc(), F.col("position").asc())
    return scores.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).drop("_rank")


def confusion_cells(metrics: DataFrame, by: Sequence[str] = ("sigma", "scope", "mechanism")) -> DataFrame:
    """The four cells added over the replicas, each with its share of its true class."""
    sums = metrics.groupBy(*by).agg(*[F.sum(cell).alias(cell) for cell in CELLS])
    layout = (
        ("attack", "alert", "true_positives"),
        ("attack", "no alert", "false_negatives"),
        ("legitimate", "alert", "false_positives"),
        ("legitimate", "no alert", "true_negatives"),
    )
    entries = [
        F.struct(F.lit(truth).alias("truth"), F.lit(said).alias("decision"), F.col(cell).alias("cases"))
        for truth, said, cell in layout
    ]
    same_truth = W.partitionBy(*by, "truth")
    return sums.select(*by, F.inline(F.array(*entries))).withColumn(
        "share_of_truth", share(F.col("cases"), F.sum("cases").over(same_truth))
    )


def grid_totals(metrics: DataFrame) -> DataFrame:
    """Replicas, attacks and legitimate sessions of each condition and scope, as the rule rows count them."""
    return (
        metrics.where(F.col("mechanism") == RULES)
        .groupBy("sigma", "scope")
        .agg(
            F.count_distinct("seed").alias("seeds"),
            F.sum("positives").alias("attacks"),
            (F.sum("sessions") - F.sum("positives")).alias("legitimate"),
        )
    )
