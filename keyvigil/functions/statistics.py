"""Paired signed-rank test and step-down correction, over tables of one row per replica or condition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: up to this many pairs without ties or zeros the null distribution is counted exactly.
EXACT_PAIRS = 50
# Where the series ends and the continued fraction begins. At this point 80 terms of either reach double precision, and
# away from it both converge faster, so the two together hold for every z.
TAIL_BEGINS = 2.5
TERMS = 80


def two_sided_normal(z: Column) -> Column:
    """P(|Z| >= |z|), with full relative precision also far out in the tail."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    return F.when(x < TAIL_BEGINS, _near_the_middle(x)).otherwise(_tail(x))


def _near_the_middle(x: Column) -> Column:
    """One minus the error function, whose series has positive terms only."""
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * k + F.lit(1.0))
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda state: state["total"])
    return F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * total


def _tail(x: Column) -> Column:
    """The complementary error function as a continued fraction, from its innermost level outwards."""
    levels = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    fraction = F.aggregate(levels, x, lambda below, k: x + k / F.lit(2.0) / below)
    return F.exp(-x * x) / (F.lit(math.sqrt(math.pi)) * fraction)


def exact_two_sided(pairs: Column, statistic: Column) -> Column:
    """2 P(W <= w) over all sign patterns.

    The number of subsets of 1..n with each rank sum is built rank by rank; only sums up to w are needed, and w is
    at most half of the largest sum.
    """
    limit = F.floor(statistic).cast("int")
    sums = F.sequence(F.lit(0), limit)
    first = F.transform(sums, lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def add_rank(counts: Column, rank: Column) -> Column:
        return F.transform(
            counts,
            lambda c, s: c + F.when(s >= rank, F.try_element_at(counts, s - rank + 1)).otherwise(F.lit(0.0)),
        )

    counts = F.aggregate(F.sequence(F.lit(1), pairs.cast("int")), first, add_rank)
    below = F.aggregate(counts, F.lit(0.0), lambda total, c: total + c)
    return F.least(F.lit(1.0), F.lit(2.0) * below / F.pow(F.lit(2.0), pairs))


def signed_rank(
    differences: DataFrame, by: Sequence[str], value: str, exact_pairs: int = EXACT_PAIRS
) -> DataFrame:
    """Two-sided test per group, zeros dropped: exact up to `exact_pairs` pairs without ties or zeros, else normal.

    Fewer than two pairs leave both results NULL, pairs that are all equal give (0, 1). A group has one row per
    replica, so its window is short.
    """
    by = list(by)
    size = F.abs(F.col(value))
    nonzero = F.col(value) != 0
    same = W.partitionBy(*by, "_nonzero", "_size")
    ranked = (
        differences.withColumn("_size", size)
        .withColumn("_nonzero", nonzero)
        .withColumn("_ties", F.count("*").over(same))
        .withColumn("_rank", F.rank().over(W.partitionBy(*by, "_nonzero").orderBy("_size")))
        .withColumn("_rank", F.col("_rank") + (F.col("_ties") - 1) / F.lit(2.0))
    )
    ties = F.col("_ties").cast("double")
    counted = ranked.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.count_if("_nonzero").alias("_n"),
        F.coalesce(F.sum(F.when(F.col(value) > 0, F.col("_rank"))), F.lit(0.0)).alias("_up"),
        F.coalesce(F.sum(F.when(F.col(value) < 0, F.col("_rank"))), F.lit(0.0)).alias("_down"),
        F.coalesce(F.sum(F.when(F.col("_nonzero"), ties * ties - 1)), F.lit(0.0)).alias("_tie_term"),
    )
    n = F.col("_n").cast("double")
    w = F.least("_up", "_down")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie_term") / 48
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(variance))
    is_exact = (F.col("_n") <= exact_pairs) & (F.col("_n") == F.col("pairs")) & (F.col("_tie_term") == 0)
    p = F.when(is_exact, exact_two_sided(F.col("_n"), w)).otherwise(two_sided_normal(z))
    undefined = F.col("pairs") < 2
    none_differ = F.col("_n") == 0
    return counted.select(
        *by,
        "pairs",
        F.when(undefined, F.lit(None)).when(none_differ, F.lit(0.0)).otherwise(w).alias("statistic"),
        F.when(undefined, F.lit(None)).when(none_differ, F.lit(1.0)).otherwise(p).alias("p_value"),
    )


def holm(rows: DataFrame, kept: Column, p_value: str, corrected: str, ties: Sequence[str]) -> DataFrame:
    """Step-down correction over the kept rows of the whole table, NULL elsewhere.

    The table has one row per condition and model of the grid, which is why one window over all of it is right.
    """
    marked = rows.withColumn("_kept", F.coalesce(kept, F.lit(False)))
    order = W.partitionBy("_kept").orderBy(F.col(p_value).asc_nulls_last(), *ties)
    left = F.count("*").over(W.partitionBy("_kept")) - F.row_number().over(order) + 1
    stepped = marked.withColumn("_step", F.col(p_value) * left)
    running = F.max("_step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return stepped.withColumn(
        corrected, F.when(F.col("_kept"), F.least(F.lit(1.0), running))
    ).drop("_kept", "_step")
