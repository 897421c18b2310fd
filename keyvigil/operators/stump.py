"""The best single cut: is one attribute and one threshold already enough?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyvigil.functions import rates
from keyvigil.functions.rates import half_even
from keyvigil.operators.calibration import in_long_form
from keyvigil.operators.ordering import running_totals
from keyvigil.schemas import ATTRIBUTES, LABEL


def _gini(positives: Column, total: Column) -> Column:
    """Impurity times size, so that two leaves can be added."""
    return F.lit(2.0) * positives * (total - positives) / total


def best_cuts(train: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Per run the attribute and midpoint with the least weighted gini, and the class of each leaf.

    Rows are first added up per (attribute, value), so only distinct values are sorted. Equal candidates go to the
    earlier attribute, then to the lower cut. A run that cannot be cut has no row.
    """
    by = list(by)
    key = [*by, "attribute"]
    long = in_long_form(train, [*by, LABEL], ATTRIBUTES)
    per_value = long.groupBy(*key, "value").agg(
        F.count("*").alias("rows"), F.count_if(F.col(LABEL) == 1).alias("positives")
    )
    placed = running_totals(per_value, key, "value", ["rows", "positives"])
    left_rows = F.col("rows_before") + F.col("rows")
    left_positives = F.col("positives_before") + F.col("positives")
    right_rows = F.col("rows_total") - left_rows
    right_positives = F.col("positives_total") - left_positives
    can_cut = (
        F.col("next_value").isNotNull()
        & (F.col("positives_total") > 0)
        & (F.col("positives_total") < F.col("rows_total"))
    )
    order = F.array(*[F.lit(name) for name in ATTRIBUTES])
    candidates = placed.where(can_cut).select(
        *by,
        F.struct(
            half_even(_gini(left_positives, left_rows) + _gini(right_positives, right_rows), 9).alias("impurity"),
            F.array_position(order, F.col("attribute")).alias("place"),
            ((F.col("value") + F.col("next_value")) / F.lit(2.0)).alias("threshold"),
            (left_positives * 2 > left_rows).cast("int").alias("below"),
            (right_positives * 2 > right_rows).cast("int").alias("above"),
        ).alias("cut"),
    )
    return candidates.groupBy(*by).agg(F.min("cut").alias("cut"))


def decision_stump(table: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """The cut learnt on the training side and its F1 on the holdout, 0 for every row where no cut exists."""
    by = list(by)
    cuts = best_cuts(table.where(F.col("side") == "train"), by)
    joined = table.where(F.col("side") == "holdout").join(cuts, by, "left")
    chosen = F.lit(None).cast("double")
    for place, name in enumerate(ATTRIBUTES, 1):
        chosen = F.when(F.col("cut.place") == place, F.col(name).cast("double")).otherwise(chosen)
    decided = F.when(chosen <= F.col("cut.threshold"), F.col("cut.below")).when(
        chosen > F.col("cut.threshold"), F.col("cut.above")
    )
    # Every row of a run carries the same cut, so the cut comes along with the counts.
    counted = (
        joined.withColumn("predicted", F.coalesce(decided, F.lit(0)))
        .groupBy(*by)
        .agg(
            *rates.confusion(F.col(LABEL), F.col("predicted")),
            F.max("cut.place").alias("_place"),
            F.max("cut.threshold").alias("_threshold"),
        )
    )
    f1 = rates.rates(*(F.col(cell) for cell in rates.CELLS))["f1"]
    names = F.array(*[F.lit(name) for name in ATTRIBUTES])
    return counted.select(
        *by,
        F.coalesce(F.get(names, (F.col("_place") - 1).cast("int")), F.lit("")).alias("stump_attribute"),
        half_even(F.col("_threshold")).alias("stump_threshold"),
        half_even(f1).alias("stump_f1"),
    )
