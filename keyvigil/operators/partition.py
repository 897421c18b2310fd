"""Train and holdout: the same draw in every condition of a replica, and folds for the search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyvigil.functions.rates import holdout_count, share
from keyvigil.operators.ordering import hash_order, numbered, ranked_by_hash
from keyvigil.operators.sessions import require_label
from keyvigil.schemas import ATTRIBUTES, CROSS_VALIDATION_FOLDS, CROSS_VALIDATION_REPEATS, LABEL
from keyvigil.session import written

TRAIN, HOLDOUT = "train", "holdout"
STABLE_ORDER = ("opened_at", "operator_id", "session_id")


def in_stable_order(sessions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Position of each session within its class, in an order sigma cannot change.

    Sessions of one operator opened at the same moment keep their order by id.
    """
    return numbered(sessions, [*by, LABEL], STABLE_ORDER, "position")


def with_ties(sessions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Running number from 0 among sessions of one operator that opened at the same moment."""
    same_moment = W.partitionBy(*by, LABEL, "operator_id", "opened_at").orderBy("session_id")
    return sessions.withColumn("tie", (F.row_number().over(same_moment) - 1).cast("bigint"))


def holdout_sizes(sessions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    return sessions.groupBy(*by, LABEL).agg(
        F.count("*").alias("sessions"), holdout_count(F.count("*")).alias("holdout")
    )


def split(
    sessions: DataFrame,
    by: Sequence[str] = ("seed",),
    drawn_by: Sequence[str] = ("seed",),
) -> DataFrame:
    """Sessions with `position` and `side`.

    Positions of a class are shuffled by a hash of (replica, class, position) and the first ones are held out. The
    draw never reads an attribute, an id or sigma, so a class of the same size gets the same positions everywhere.
    """
    require_label(sessions)
    placed = in_stable_order(sessions, by)
    key = hash_order(*[F.col(name) for name in drawn_by], F.col(LABEL), F.col("position"))
    ranked = ranked_by_hash(placed.withColumn("_draw", key), [*by, LABEL], "_draw", "_rank")
    sizes = holdout_sizes(placed, by).select(*by, LABEL, "holdout")
    held = F.col("_rank") <= F.col("holdout")
    return (
        ranked.join(sizes, [*by, LABEL])
        .withColumn("side", F.when(held, HOLDOUT).otherwise(TRAIN))
        .drop("_draw", "_rank", "holdout")
    )


def written_split(sessions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """The split as a table with one folder per run, for the many readers that follow.

    Rows of a run are gathered before the write; a run that is too large for one task is cut, small ones are merged.
    """
    return written(split(sessions, by).hint("rebalance", *by), "split", partitioned_by=by)


def side(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("side") == name).drop("side", "position")


def side_counts(table: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Sessions and positives of each side, one row per run."""
    columns = []
    for name in (TRAIN, HOLDOUT):
        here = F.col("side") == name
        columns.append(F.count_if(here).alias(f"{name}_sessions"))
        columns.append(F.count_if(here & (F.col(LABEL) == 1)).alias(f"{name}_positives"))
    return table.groupBy(*by).agg(*columns)


def side_shares(table: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    positives = F.count_if(F.col(LABEL) == 1)
    return table.groupBy(*by, "side").agg(
        F.count("*").alias("sessions"),
        positives.alias("positives"),
        share(positives, F.count("*")).alias("positive_share"),
    )


def duplicates(table: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Session ids on both sides, and held-out rows whose eight attributes also occur in training.

    Equal rows are added up before anything meets: per id and per 8-tuple one row says how often each side has it, so
    no join is needed and a tuple shared by very many sessions costs one row per task.
    """
    def per(columns: Sequence[str]) -> DataFrame:
        return table.groupBy(*by, *columns).agg(
            F.count_if(F.col("side") == TRAIN).alias("in_train"),
            F.count_if(F.col("side") == HOLDOUT).alias("in_holdout"),
        )

    shared = per(["session_id"]).groupBy(*by).agg(
        F.count_if((F.col("in_train") > 0) & (F.col("in_holdout") > 0)).alias("shared_sessions")
    )
    repeated = per(ATTRIBUTES).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("in_train") > 0, F.col("in_holdout"))), F.lit(0)).alias("repeated_sessions")
    )
    return shared.join(repeated, list(by))


def folds(
    train: DataFrame,
    by: Sequence[str] = ("seed",),
    count: int = CROSS_VALIDATION_FOLDS,
    repeats: int = CROSS_VALIDATION_REPEATS,
) -> DataFrame:
    """Fold of each row in each repeat, balanced within each class."""
    repeated = train.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    key = hash_order(*[F.col(name) for name in by], F.col("repeat"), F.col("session_id"))
    ranked = ranked_by_hash(
        repeated.withColumn("_draw", key),
        [*by, "repeat", LABEL],
        "_draw",
        "_rank",
        ties=("session_id",),
    )
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % count).cast("int")).drop("_draw", "_rank")
