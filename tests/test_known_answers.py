"""Small literals with answers worked out by hand."""

from __future__ import annotations

import itertools
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from keyvigil.functions import rates
from keyvigil.functions.calendar import EVALUATED, WARMUP, Period, is_business_day
from keyvigil.functions.statistics import holm, signed_rank
from keyvigil.functions.text import identifier, join_cell, split_cell, verdict
from keyvigil.operators import evaluation


def _measured(spark, truth, decided):
    frame = spark.createDataFrame(list(zip(truth, decided)), "truth int, decided int")
    counted = frame.agg(*rates.confusion(F.col("truth"), F.col("decided")))
    return counted.select("*", *rates.rate_columns(None), *rates.roc_point()).first()


def test_confusion_and_rates(spark):
    row = _measured(spark, [1, 1, 0, 0, 0], [1, 0, 1, 0, 0])
    assert [row[cell] for cell in rates.CELLS] == [1, 1, 2, 1]
    assert (row.f1, row.accuracy) == (0.5, 0.6)
    assert row.specificity == pytest.approx(2 / 3)
    assert (row.false_positive_rate, row.true_positive_rate) == (pytest.approx(1 / 3), 0.5)


def test_without_alerts_precision_is_zero(spark):
    row = _measured(spark, [1, 0, 0], [0, 0, 0])
    assert (row.precision, row.f1, row.specificity) == (0.0, 0.0, 1.0)


def test_rates_without_cases_are_null(spark):
    row = _measured(spark, [0, 0], [0, 0])
    assert row.recall is None and row.f1 is None and row.precision == 0.0


def _scores(spark, truth, scores):
    return spark.createDataFrame(
        [("r", t, int(s >= 0.5), s) for t, s in zip(truth, scores)], "run string, compromised int, predicted int, score double"
    )


def test_area_of_a_perfect_score_is_one(spark):
    assert evaluation.areas(_scores(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), ["run"]).first().roc_auc == 1.0


def test_area_counts_half_for_ties(spark):
    assert evaluation.areas(_scores(spark, [0, 1, 0, 1], [0.5, 0.5, 0.1, 0.1]), ["run"]).first().roc_auc == 0.5


def test_curve_ends_at_one_one(spark):
    curve = evaluation.roc_curve(_scores(spark, [0, 1, 0, 1], [0.5, 0.7, 0.1, 0.5]), ["run"])
    points = sorted((row.false_positive_rate, row.true_positive_rate) for row in curve.collect())
    assert points == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_class_balance_weight(spark):
    frame = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert frame.agg(rates.negatives_per_positive(F.col("label")).alias("w")).first().w == 3.0


@pytest.mark.parametrize("total, held", [(58, 23), (10, 4), (3, 1), (0, 0), (5, 2)])
def test_holdout_count_rounds_a_half_up(spark, total, held):
    assert spark.range(1).select(rates.holdout_count(F.lit(total)).alias("n")).first().n == held


@pytest.mark.parametrize("value, rounded", [(0.03125, 0.0312), (0.09375, 0.0938), ((0.1667 + 0.25) / 2, 0.2084)])
def test_ties_go_to_the_even_digit(spark, value, rounded):
    assert spark.range(1).select(rates.half_even(F.lit(value)).alias("x")).first().x == rounded


def _signed(spark, values):
    frame = spark.createDataFrame([("c", float(v)) for v in values], "g string, d double")
    return signed_rank(frame, ["g"], "d").first()


def _brute_p(values):
    """All sign patterns of untied ranks."""
    n = len(values)
    ranks = {v: i + 1 for i, v in enumerate(sorted(values, key=abs))}
    w = min(sum(ranks[v] for v in values if v > 0), sum(ranks[v] for v in values if v < 0))
    below = sum(
        1 for signs in itertools.product((0, 1), repeat=n) if sum(s * r for s, r in zip(signs, range(1, n + 1))) <= w
    )
    return w, min(1.0, 2 * below / 2**n)


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5], [1, -2, 3, -4, 5, 6, 7], [-1, 2, -3, 4, 5, 6, 7, 8, 9, 10]])
def test_exact_signed_rank_equals_enumeration(spark, values):
    row = _signed(spark, values)
    w, p = _brute_p(values)
    assert (row.statistic, row.p_value) == (w, pytest.approx(p, abs=1e-12))


def test_exact_signed_rank_of_thirty_pairs(spark):
    # Ranks 1..30 with a negative sum of 137.
    negative = {30, 29, 28, 27, 23}
    row = _signed(spark, [-v if v in negative else v for v in range(1, 31)])
    assert row.statistic == 137
    assert row.p_value == pytest.approx(0.049710121, abs=1e-9)


def test_ties_use_the_normal_law(spark):
    # n = 6, ranks of sizes 1 1 2 2 3 4: W- = 1.5, variance 22.75 - 12/48.
    row = _signed(spark, [1, -1, 2, 2, 3, 4])
    assert row.statistic == 1.5
    z = (1.5 - 10.5) / (22.75 - 0.25) ** 0.5
    assert row.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


def test_equal_pairs_and_single_pairs(spark):
    equal = _signed(spark, [0] * 30)
    assert (equal.statistic, equal.p_value) == (0.0, 1.0)
    alone = _signed(spark, [0.5])
    assert alone.statistic is None and alone.p_value is None


def test_step_down_correction_over_kept_rows(spark):
    rows = spark.createDataFrame(
        [("a", 0.01, True), ("b", 0.04, True), ("c", 0.001, False), ("d", None, True)], "k string, p double, kept boolean"
    )
    found = holm(rows, F.col("kept") & F.col("p").isNotNull(), "p", "c", ["k"]).orderBy("k").collect()
    assert [row.c for row in found] == [0.02, 0.04, None, None]


def test_phases_are_half_open(spark):
    period = Period()
    moments = ["2026-01-04 23:59:59", "2026-01-05 00:00:00", "2026-02-01 23:59:59", "2026-02-02 00:00:00", "2026-03-02 00:00:00"]
    frame = spark.createDataFrame([(m,) for m in moments], "m string").select(F.col("m").cast("timestamp_ntz").alias("m"))
    found = [row.p for row in frame.select("m", period.phase_of(F.col("m")).alias("p")).orderBy("m").collect()]
    assert found == [None, WARMUP, WARMUP, EVALUATED, None]


def test_weeks_and_days(spark):
    period = Period()
    assert period.first_day_of(5) == date(2026, 2, 2)
    assert period.day_after_last_of(8) == date(2026, 3, 2)
    assert (period.days, period.day_spine(spark).count()) == (56, 56)
    assert period.day_spine(spark, WARMUP).where(is_business_day(F.col("day"))).count() == 20
    with pytest.raises(ValueError, match="unknown phase"):
        period.belongs_to("later", F.col("m"))


def test_text_cells_and_identifiers(spark):
    row = spark.range(1).select(
        join_cell(split_cell(F.lit("b|a|b"))).alias("cell"),
        identifier("event", F.lit(7), 6).alias("short"),
        identifier("event", F.lit(12345678), 6).alias("long"),
        verdict(F.lit(True), F.lit(True)).alias("first"),
        verdict(F.lit(False), F.lit(True)).alias("second"),
        verdict(F.lit(False), F.lit(False)).alias("third"),
    ).first()
    assert tuple(row) == ("a|b", "event_000007", "event_12345678", "excluded", "significant", "not significant")
