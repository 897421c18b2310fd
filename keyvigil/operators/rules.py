"""The rule baseline: eight rules, an alert where two or more fire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyvigil.operators.calibration import cutoffs
from keyvigil.operators.sessions import require_label
from keyvigil.schemas import (
    ATTRIBUTES,
    HISTORY_ATTRIBUTES,
    HISTORY_RULE_FIRES_AT,
    IDENTIFIERS,
    LABEL,
    MAGNITUDE_ATTRIBUTES,
    MINIMUM_RULES_FIRED,
    RULE_COLUMNS,
)


def fires(attribute: str) -> Column:
    """1 or 0. A magnitude rule fires strictly above its cutoff, a history rule on its flag.

    A rule without a cutoff, or about a value that is not known, doesn't fire.
    """
    if attribute in MAGNITUDE_ATTRIBUTES:
        fired = F.col(attribute) > F.col(f"cutoff_{attribute}")
    else:
        fired = F.col(attribute) == HISTORY_RULE_FIRES_AT
    return F.coalesce(fired, F.lit(False)).cast("int")


def with_rules(sessions: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Sessions with their eight flags, the count and the decision. Every session gets one.

    A replica without thresholds keeps its sessions; its magnitude rules don't fire. Where that is an error,
    `calibration.require_thresholds_of` says so.
    """
    joined = sessions.join(cutoffs(thresholds, by), list(by), "left")
    flags = joined.select("*", *[fires(name).alias(f"rule_{name}") for name in ATTRIBUTES])
    fired = F.lit(0)
    for column in RULE_COLUMNS:
        fired = fired + F.col(column)
    return (
        flags.withColumn("rules_fired", fired)
        .withColumn("predicted", (F.col("rules_fired") >= MINIMUM_RULES_FIRED).cast("int"))
        .drop(*[f"cutoff_{name}" for name in MAGNITUDE_ATTRIBUTES])
    )


def rule_predictions(
    holdout: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("seed",), run: Sequence[str] | None = None
) -> DataFrame:
    """Why each session did or did not raise an alert. The label is carried along and not read.

    Thresholds belong to a replica (`by`), sessions to a run (`run`, the same if not given).
    """
    require_label(holdout)
    scored = with_rules(holdout, thresholds, by)
    return scored.select(*(run or by), *IDENTIFIERS, *RULE_COLUMNS, "rules_fired", "predicted", LABEL)


def rule_catalogue(thresholds: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """The eight rules of each replica with the value each compares against."""
    wide = cutoffs(thresholds, by)
    entries = []
    for place, name in enumerate(ATTRIBUTES):
        is_history = name in HISTORY_ATTRIBUTES
        entries.append(
            F.struct(
                F.lit(place).alias("place"),
                F.lit(name).alias("rule"),
                F.lit("history" if is_history else "magnitude").alias("kind"),
                (F.lit(float(HISTORY_RULE_FIRES_AT)) if is_history else F.col(f"cutoff_{name}")).alias("fires_at"),
            )
        )
    return wide.select(*by, F.inline(F.array(*entries)))
