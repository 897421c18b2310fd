"""Numbering, running totals, quantiles and hash order over groups of any size.

A plain window sends a whole group to one task. With a few replicas and very many rows that task is the job, so
here a group is always cut into pieces first: by range of the sort key, by value, or by leading digits of a hash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyvigil.session import written

VALUE_SLICES_PER_E_FOLD = 1000.0

_SLICE, _BUCKET, _OFFSET = "_slice", "_bucket", "_offset"
_BEFORE = (W.unboundedPreceding, -1)


def sliced(frame: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows range-partitioned on `order`, each with the number of its slice, written once.

    `order` has to be total (end it with a unique id), so equal keys can never pile up in one slice. The write is what
    makes the slice number safe to use twice: a range partitioner samples, and a second run may cut elsewhere.
    """
    ranged = frame.repartitionByRange(*[F.col(column) for column in order])
    return written(ranged.withColumn(_SLICE, F.spark_partition_id()), name)


def numbered(
    frame: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    position: str = "position",
) -> DataFrame:
    """Row number from 1 within each group, in two passes: count the slices, then number inside them.

    Both windows are small: the first has one row per (group, slice), the second one slice.
    """
    group = list(group)
    cut = sliced(frame, [*group, *order], "numbered")
    counts = cut.groupBy(*group, _SLICE).agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy(*group).orderBy(_SLICE).rowsBetween(*_BEFORE)
    offsets = counts.select(*group, _SLICE, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias(_OFFSET))
    inside = W.partitionBy(*group, _SLICE).orderBy(*order)
    return (
        cut.join(offsets, [*group, _SLICE])
        .withColumn(position, F.col(_OFFSET) + F.row_number().over(inside))
        .drop(_SLICE, _OFFSET)
    )


def with_previous(
    frame: DataFrame, group: Sequence[str], order: Sequence[str], value: str, previous: str
) -> DataFrame:
    """`lag` within a group that may be split over many slices.

    Inside a slice it is an ordinary window; the first row of a slice takes the last row of the slice before. That
    hand-over table has one row per slice, so it is small whatever the data.
    """
    group = list(group)
    keys = [*group, *order]
    cut = sliced(frame, keys, "previous")
    last = cut.groupBy(_SLICE).agg(F.max(F.struct(*keys, F.col(value).alias("_value"))).alias("_last"))
    slices = W.orderBy(_SLICE)
    handed = last.select(
        _SLICE, F.lag("_last").over(slices).alias("_handed")
    ).where(F.col("_handed").isNotNull())
    inside = W.partitionBy(*group, _SLICE).orderBy(*order)
    same_group = F.lit(True)
    for column in group:
        same_group = same_group & (F.col(f"_handed.{column}") == F.col(column))
    return (
        cut.join(handed, _SLICE, "left")
        .withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn(
            previous,
            F.when(F.col("_first"), F.when(same_group, F.col("_handed._value"))).otherwise(
                F.lag(value).over(inside)
            ),
        )
        .drop(_SLICE, "_handed", "_first")
    )


def hash_order(*parts: Column) -> Column:
    """A repeatable shuffle key that any SQL engine computes alike."""
    return F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))


def ranked_by_hash(
    frame: DataFrame, group: Sequence[str], key: str, rank: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Rank from 1 of a hash text within each group, without one task per group.

    The hash cuts a group into even buckets: its leading digits, read as a number below 2**32, fall into as many equal
    ranges as the session has shuffle partitions, so the buckets grow in number with the cluster and the data. Counts of
    the lower buckets give the offset, a window inside the bucket the rest.
    """
    group = list(group)
    pieces = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    cut = frame.withColumn(_BUCKET, F.floor(leading * pieces / 2**32))
    counts = cut.groupBy(*group, _BUCKET).agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy(*group).orderBy(_BUCKET).rowsBetween(*_BEFORE)
    offsets = counts.select(*group, _BUCKET, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias(_OFFSET))
    inside = W.partitionBy(*group, _BUCKET).orderBy(key, *ties)
    return (
        cut.join(offsets, [*group, _BUCKET])
        .withColumn(rank, F.col(_OFFSET) + F.row_number().over(inside))
        .drop(_BUCKET, _OFFSET)
    )


def value_bucket(value: Column) -> Column:
    """A non-decreasing whole number of the value. Its range is bounded for every double, near 28,000 up to 1e12."""
    steps = F.floor(F.log1p(F.abs(value)) * F.lit(VALUE_SLICES_PER_E_FOLD))
    return F.when(value < 0, -steps).otherwise(steps)


def running_totals(
    values: DataFrame, group: Sequence[str], value: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """For one row per (group, value): the sum of every earlier value (`x_before`) and of all (`x_total`), and the
    value that follows (`next_value`, NULL after the last).

    The caller has already added up equal values, so heavy ties are one row. Values are bucketed by size; a window
    over the bucket sums gives the offset and a window inside the bucket the rest.
    """
    group = list(group)
    bucketed = values.withColumn(_BUCKET, value_bucket(F.col(value)))
    first = F.max(value) if descending else F.min(value)
    per_bucket = bucketed.groupBy(*group, _BUCKET).agg(first.alias("_first"), *[F.sum(s).alias(f"_{s}") for s in sums])
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    value_order = F.col(value).desc() if descending else F.col(value).asc()
    whole = W.partitionBy(*group)
    in_order = whole.orderBy(bucket_order)
    earlier = in_order.rowsBetween(*_BEFORE)
    offsets = per_bucket.select(
        *group,
        _BUCKET,
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums],
        F.lead("_first").over(in_order).alias("_after"),
    )
    inside = W.partitionBy(*group, _BUCKET).orderBy(value_order)
    so_far = inside.rowsBetween(*_BEFORE)
    return bucketed.join(offsets, [*group, _BUCKET]).select(
        *values.columns,
        *[f"{s}_total" for s in sums],
        *[
            (F.col(f"_{s}_offset") + F.coalesce(F.sum(s).over(so_far), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
        F.coalesce(F.lead(value).over(inside), F.col("_after")).alias("next_value"),
    )


def quantiles(
    frame: DataFrame,
    group: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    count: str = "rows",
) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    Equal values are added up on the map side first; the two order statistics around each position are then picked by
    their cumulative counts. The counts are stored, since they are read twice and what they come from may be large.
    """
    group = list(group)
    key = group or ["_all"]
    source = frame if group else frame.withColumn("_all", F.lit(1))
    counts = source.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    placed = running_totals(written(counts, "value-counts"), key, value, ["n"])

    def order_statistic(place: Column) -> Column:
        covers = (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))
        return F.max(F.when(covers, F.col(value)))

    columns = [F.max("n_total").alias(count)]
    for name, probability in wanted.items():
        low = F.floor(_place(probability))
        columns.append(order_statistic(low).alias(f"_{name}_low"))
        columns.append(order_statistic(F.least(low + 1, F.col("n_total") - 1)).alias(f"_{name}_high"))
    picked = placed.groupBy(*key).agg(*columns)
    results = []
    for name, probability in wanted.items():
        place = F.lit(probability) * (F.col(count) - 1)
        low, high = F.col(f"_{name}_low").cast("double"), F.col(f"_{name}_high").cast("double")
        results.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*group, F.col(count).cast("bigint").alias(count), *results)


def _place(probability: float) -> Column:
    return F.lit(probability) * (F.col("n_total") - 1)


def integer_spine(frame: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """One row per whole number from low to high, exploded in two steps so that no single array is long.

    The steps are as long as the square root of the range, so neither array is longer than that.
    """
    low, high = low.cast("bigint"), high.cast("bigint")
    step = F.greatest(F.lit(1024), F.ceil(F.sqrt((high - low).cast("double")))).cast("bigint")
    return (
        frame.withColumn("_step", step)
        .withColumn("_from", F.explode(F.sequence(low, high, F.col("_step"))))
        .withColumn("_last", F.least(F.col("_from") + F.col("_step") - 1, high))
        .withColumn(name, F.explode(F.sequence("_from", "_last")))
        .drop("_from", "_last", "_step")
    )


def largest_remainder(
    weights: DataFrame, group: Sequence[str], key: str, weight: str, total: int, quota: str = "quota"
) -> DataFrame:
    """Whole-number quotas proportional to the weights that add up to `total` in each group.

    One row per stratum comes in, so a group is as small as the list of strata.
    """
    whole = W.partitionBy(*group)
    exact = F.col(weight).cast("double") * F.lit(float(total)) / F.sum(weight).over(whole)
    floors = weights.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    ranked = floors.withColumn("_left", F.lit(total) - F.sum("_floor").over(whole)).withColumn(
        "_rank",
        F.row_number().over(whole.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(key).asc())),
    )
    given = F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return ranked.withColumn(quota, given.cast("bigint")).drop("_exact", "_floor", "_left", "_rank")
