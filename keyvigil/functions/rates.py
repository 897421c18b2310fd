"""Confusion counts and the rates that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyvigil.schemas import HOLDOUT_SHARE, SUCCESS, DENIED_BY_POLICY

CELLS = ("true_positives", "false_positives", "true_negatives", "false_negatives")
RATES = ("f1", "precision", "recall", "accuracy", "specificity")


SNAP_DIGITS = 10


def half_even(value: Column, digits: int = 4) -> Column:
    """Half to even, after noise far behind the last digit is cut off.

    The midpoint of 0.1667 and 0.25 is a tie on paper and just below one in binary; snapping first makes it a tie.
    """
    return F.bround(F.bround(value, SNAP_DIGITS), digits)


def share(part: Column, whole: Column) -> Column:
    """NULL, never an error, when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def confusion(truth: Column, decided: Column) -> list[Column]:
    """Four counts over a grouping, class 1 being the positive one."""
    wanted = {
        "true_positives": (1, 1),
        "false_positives": (0, 1),
        "true_negatives": (0, 0),
        "false_negatives": (1, 0),
    }
    return [
        F.count_if((truth == actual) & (decided == said)).alias(cell) for cell, (actual, said) in wanted.items()
    ]


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Precision is 0 without alerts; any other rate without cases is NULL."""
    return {
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "precision": F.when(tp + fp == 0, F.lit(0.0)).otherwise(share(tp, tp + fp)),
        "recall": share(tp, tp + fn),
        "accuracy": share(tp + tn, tp + fp + tn + fn),
        "specificity": share(tn, tn + fp),
    }


def rate_columns(digits: int | None = 4) -> list[Column]:
    exact = rates(*(F.col(cell) for cell in CELLS))
    return [(value if digits is None else half_even(value, digits)).alias(name) for name, value in exact.items()]


def roc_point() -> list[Column]:
    tp, fp, tn, fn = (F.col(cell) for cell in CELLS)
    return [share(fp, fp + tn).alias("false_positive_rate"), share(tp, tp + fn).alias("true_positive_rate")]


def negatives_per_positive(label: Column) -> Column:
    positives = F.count_if(label == 1)
    return share(F.count_if(label == 0), positives)


def holdout_count(total: Column) -> Column:
    """Nearest integer of the holdout share, a half going up."""
    return F.floor(total * F.lit(HOLDOUT_SHARE) + F.lit(0.5))


def failures(outcome: Column) -> Column:
    return F.count_if(outcome != SUCCESS)


def denials(outcome: Column) -> Column:
    return F.count_if(outcome == DENIED_BY_POLICY)
