"""Multi-value cells, identifiers, typed parameters and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyvigil.schemas import MULTIVALUE_SEPARATOR


def split_cell(cell: Column) -> Column:
    return F.split(cell, "[|]")


def join_cell(values: Column) -> Column:
    """Sorted distinct values in one text cell."""
    return F.array_join(F.array_sort(F.array_distinct(values)), MULTIVALUE_SEPARATOR)


def padded(number: Column, width: int) -> Column:
    """Zero padded, and never cut when the number is wider (`lpad` alone would cut)."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def identifier(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(f"{prefix}_"), padded(number, width))


def parameter_kind(value: Column) -> Column:
    """none, integer, real or text: the first of these readings that fits."""
    return (
        F.when(value == "None", "none")
        .when(value.try_cast("bigint").isNotNull(), "integer")
        .when(value.try_cast("double").isNotNull(), "real")
        .otherwise("text")
    )


def verdict(excluded: Column, significant: Column) -> Column:
    return F.when(excluded, "excluded").when(significant, "significant").otherwise("not significant")
