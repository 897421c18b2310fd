"""Numbering, running totals, quantiles and hash order against brute force, with one group that holds most rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyvigil.operators import ordering


@pytest.fixture(scope="module")
def skewed() -> pd.DataFrame:
    rng = random.Random(7)
    groups = ["hot"] * 900 + ["cold"] * 60 + ["rare"] * 3
    frame = pd.DataFrame(
        {
            "g": groups,
            "t": [rng.randrange(50) for _ in groups],
            "id": [f"r{i:05d}" for i in range(len(groups))],
            "v": [round(rng.expovariate(0.1), 4) if rng.random() > 0.3 else 2.5 for _ in groups],
        }
    )
    return frame.sample(frac=1, random_state=1).reset_index(drop=True)


def test_numbers_follow_the_total_order(spark, skewed):
    expected = skewed.sort_values(["g", "t", "id"])
    expected["position"] = expected.groupby("g").cumcount() + 1
    found = ordering.numbered(spark.createDataFrame(skewed), ["g"], ["t", "id"]).toPandas()
    merged = found.merge(expected[["id", "position"]], on="id", suffixes=("", "_expected"))
    assert len(merged) == len(skewed)
    assert (merged["position"] == merged["position_expected"]).all()


def test_previous_value_crosses_slices(spark, skewed):
    ordered = skewed.sort_values(["g", "t", "id"])
    ordered["expected"] = ordered.groupby("g")["v"].shift(1)
    found = ordering.with_previous(spark.createDataFrame(skewed), ["g"], ["t", "id"], "v", "before").toPandas()
    merged = found.merge(ordered[["id", "expected"]], on="id")
    assert len(merged) == len(skewed)
    assert np.array_equal(merged["before"].to_numpy(), merged["expected"].to_numpy(), equal_nan=True)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_count_the_earlier_values(spark, skewed, descending):
    counts = skewed.groupby(["g", "v"]).size().rename("n").reset_index()
    ordered = counts.sort_values(["g", "v"], ascending=[True, not descending])
    ordered["before"] = ordered.groupby("g")["n"].cumsum() - ordered["n"]
    ordered["following"] = ordered.groupby("g")["v"].shift(-1)
    found = ordering.running_totals(spark.createDataFrame(counts), ["g"], "v", ["n"], descending).toPandas()
    merged = found.merge(ordered[["g", "v", "before", "following"]], on=["g", "v"])
    assert len(merged) == len(counts)
    assert (merged["n_before"] == merged["before"]).all()
    assert np.array_equal(merged["next_value"].to_numpy(), merged["following"].to_numpy(), equal_nan=True)


def test_buckets_keep_the_order_of_values(spark):
    values = sorted([-1e9, -3.5, -3.4999, -1e-6, 0.0, 1e-9, 0.5, 0.5001, 10.0, 1e6, 1e12])
    found = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", ordering.value_bucket(F.col("v")).alias("b")
    )
    buckets = [row.b for row in found.orderBy("v").collect()]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_interpolate_like_numpy(spark, skewed, share):
    found = ordering.quantiles(spark.createDataFrame(skewed), ["g"], "v", {"q": share}).toPandas().set_index("g")
    for group, rows in skewed.groupby("g"):
        assert found.loc[group, "q"] == pytest.approx(np.percentile(rows["v"], share * 100), abs=1e-9)
        assert found.loc[group, "rows"] == len(rows)


def test_quantile_of_everything_needs_no_group(spark, skewed):
    found = ordering.quantiles(spark.createDataFrame(skewed), [], "v", {"q": 0.5}).first()
    assert found.q == pytest.approx(skewed["v"].median())


def test_hash_rank_is_the_order_of_the_hash(spark, skewed):
    keyed = spark.createDataFrame(skewed).withColumn("h", ordering.hash_order(F.col("g"), F.col("id")))
    found = ordering.ranked_by_hash(keyed, ["g"], "h", "rank").toPandas()
    for group, rows in skewed.groupby("g"):
        expected = sorted(rows["id"], key=lambda i: hashlib.md5(f"{group}|{i}".encode()).hexdigest())
        got = found[found["g"] == group].sort_values("rank")["id"].tolist()
        assert got == expected


def test_integer_spine_is_whole_beyond_one_step(spark):
    bounds = spark.createDataFrame([("a", 0, 5000), ("b", 3, 3)], "g string, low long, high long")
    found = ordering.integer_spine(bounds, F.col("low"), F.col("high"), "x")
    assert found.groupBy("g").agg(F.count("*"), F.min("x"), F.max("x")).orderBy("g").collect() == [
        ("a", 5001, 0, 5000),
        ("b", 1, 3, 3),
    ]


def test_quotas_add_up_to_the_total(spark):
    weights = spark.createDataFrame([("s", "a", 5.0), ("s", "b", 3.0), ("s", "c", 3.0), ("s", "d", 1.0)], "g string, k string, w double")
    rows = ordering.largest_remainder(weights, ["g"], "k", "w", 10).orderBy("k").collect()
    assert [row.quota for row in rows] == [4, 3, 2, 1]
    assert sum(row.quota for row in rows) == 10
