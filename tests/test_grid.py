"""Runs of one grid in one job: shared ids, a campaign per sigma, strangers and replicas without thresholds."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyvigil.functions.statistics import signed_rank
from keyvigil.operators import calibration, description, evaluation, policy, quality, sessions
from keyvigil.plans.pipeline import Pipeline

LOG = (
    "seed bigint, sigma double, phase string, event_id string, session_id string, operator_id string, timestamp timestamp_ntz, "
    "source_ip string, key_id string, outcome string"
)


def _rows(seed, sigma, phase, day, sizes, operator="user_01", source=None):
    """One session per size; ids start again in every run, as they do in every replica."""
    rows = []
    for number, size in enumerate(sizes):
        for k in range(size):
            moment = datetime(2024, 1, day, 9) + timedelta(days=number % 5, seconds=30 * k)
            rows.append((seed, sigma, phase, f"e{number}-{k}", f"s{number}-{phase[0]}", operator, moment, source or f"10.0.{seed}.1",
                         f"k{k % 3}", "denied_by_policy" if k % 4 == 3 else "success"))
    return rows


@pytest.fixture(scope="module")
def grid(spark):
    rows = []
    for seed in (1, 2):
        rows += _rows(seed, None, "warmup", 1, [3, 4, 5, 4, 3, 2])
        for sigma in (0.0, 1.0):
            rows += _rows(seed, sigma, "evaluated", 15, [3, 4, 40 if (seed, sigma) == (1, 0.0) else 4])
    marks = [(1, 0.0, "s2-e"), (1, 1.0, "s0-e"), (2, 1.0, "s1-e")]
    return spark.createDataFrame(rows, LOG).cache(), spark.createDataFrame(marks, "seed bigint, sigma double, session_id string")


def test_runs_that_share_all_ids_stay_apart(grid):
    log, marks = grid
    audit = Pipeline(log, marks, run=("seed", "sigma")).check()
    found = {(r.seed, r.sigma, r.session_id): (r.events, r.compromised) for r in audit.evaluated.collect()}
    assert len(found) == 12
    assert found[1, 0.0, "s2-e"] == (40, 1) and found[1, 1.0, "s2-e"] == (4, 0) and found[2, 0.0, "s2-e"] == (4, 0)
    assert {k for k, v in found.items() if v[1]} == {(1, 0.0, "s2-e"), (1, 1.0, "s0-e"), (2, 1.0, "s1-e")}
    assert audit.thresholds.count() == 12 and audit.warmup_sessions.count() == 12
    alerts = {(r.seed, r.sigma, r.session_id): r.rules_fired for r in audit.alerts.collect()}
    assert len(alerts) == 12 and alerts[1, 0.0, "s2-e"] > alerts[1, 1.0, "s2-e"] == alerts[2, 0.0, "s2-e"]


def test_each_run_equals_its_own_job(grid):
    """The job over the grid gives what one job per run gives."""
    log, marks = grid
    whole = Pipeline(log, marks, run=("seed", "sigma"))
    for seed, sigma in ((1, 0.0), (2, 1.0)):
        one = log.where((F.col("seed") == seed) & (F.col("sigma").isNull() | (F.col("sigma") == sigma))).drop("sigma")
        own = marks.where((F.col("seed") == seed) & (F.col("sigma") == sigma)).drop("sigma")
        single = Pipeline(one, own).alerts
        same = whole.alerts.where((F.col("seed") == seed) & (F.col("sigma") == sigma)).select(single.columns)
        assert sorted(same.collect()) == sorted(single.collect())


def test_strangers_and_replicas_without_thresholds_get_decisions(spark, grid):
    log, marks = grid
    extra = spark.createDataFrame(
        _rows(1, 0.0, "evaluated", 16, [9], "ghost", "9.9.9.9") + _rows(3, 0.0, "evaluated", 15, [9]), LOG
    ).withColumn("session_id", F.concat(F.lit("x"), "session_id"))
    audit = Pipeline(log.unionByName(extra), marks, run=("seed", "sigma"))
    alerts = audit.alerts
    assert alerts.count() == audit.evaluated.count() == 14
    assert alerts.where("predicted IS NULL OR rules_fired IS NULL").count() == 0
    stranger = alerts.where("operator_id = 'ghost'").first()
    assert (stranger.rule_atypical_hour, stranger.rule_new_source_ip, stranger.predicted) == (1, 1, 1)
    cells = evaluation.confusion_counts(alerts, ("seed", "sigma")).collect()
    assert sum(r.true_positives + r.false_positives + r.true_negatives + r.false_negatives for r in cells) == 14
    with pytest.raises(ValueError, match="no complete set"):
        audit.check()
    with pytest.raises(KeyError, match="ghost"):
        Pipeline(log.unionByName(extra.where("seed = 1")), marks, run=("seed", "sigma")).check()
    assert [tuple(r) for r in calibration.replicas_without_thresholds(audit.evaluated, audit.thresholds).collect()] == [(3,)]


def test_replicas_with_shared_operators_do_not_mix(spark):
    operators = spark.createDataFrame(
        [(1, "o1", "administrator", ["a"], "routine", ["10.0.0.1"]), (2, "o1", "end_user", ["b"], "routine", ["10.0.0.2"])],
        "seed bigint, operator_id string, profile string, scopes array<string>, regime string, usual_ips array<string>",
    )
    keys = spark.createDataFrame([("k1", "a", "active"), ("k2", "b", "active")], "key_id string, scope string, status string")
    requests = spark.createDataFrame(
        [(s, "e1", "s1", "o1", datetime(2024, 1, 2, 9), f"10.0.0.{s}", "Decrypt", "k1") for s in (1, 2)],
        "seed bigint, event_id string, session_id string, operator_id string, timestamp timestamp_ntz, source_ip string, operation string, key_id string",
    )
    by = ("seed",)
    grants = policy.grants_of(operators, by)
    decided = {r.seed: r.outcome for r in policy.decided(requests, keys, grants, by, ()).collect()}
    assert decided == {1: "success", 2: "denied_by_policy"}
    traffic = description.traffic_sessions(requests, operators)
    assert sorted((r.seed, r.events, r.from_primary) for r in traffic.collect()) == [(1, 1, True), (2, 1, True)]
    assert {(r.seed, r.scope): r.holders for r in policy.holders_by_scope(grants, by).collect()} == {(1, "a"): 1, (2, "b"): 1}
    assert policy.novel_addresses(requests, operators, by).count() == 0
    assert {r.violations for r in quality.log_invariants(requests).collect()} == {0}
    marks = spark.createDataFrame([(1, "s1")], "seed bigint, session_id string")
    assert {r.seed: r.compromised for r in sessions.with_label(traffic, marks).collect()} == {1: 1, 2: 0}
    scored = requests.withColumn("mechanism", F.lit("m"))
    scopes = {(r.seed, r.scope) for r in evaluation.in_scopes(scored, policy.administrators_of(operators), by).collect()}
    assert scopes == {(1, "all"), (2, "all"), (1, "administrators")}


@pytest.mark.parametrize("pairs", [51, 300, 350, 1000])
def test_many_pairs_of_one_sign_are_significant(spark, pairs):
    frame = spark.range(1, pairs + 1).select(F.lit("g").alias("g"), (F.col("id") / 1000.0).alias("d"))
    found = signed_rank(frame, ["g"], "d").first()
    assert found.statistic == 0 and 0 <= found.p_value < 1e-6


def test_normal_tail_everywhere(spark):
    import math

    from keyvigil.functions.statistics import two_sided_normal

    zs = [0.0, 0.01, 0.5, 1.0, 1.96, 3.0, 3.5, 3.5355, 3.536, 4.0, 6.0, 10.0, 25.0, 37.0]
    found = spark.createDataFrame([(z,) for z in zs], "z double").select("z", two_sided_normal(F.col("z")).alias("p")).collect()
    for row in found:
        assert row.p == pytest.approx(math.erfc(row.z / math.sqrt(2)), rel=1e-10)


def test_log_factorial_of_large_and_small_counts(spark):
    import math

    from keyvigil.functions.distributions import log_factorial

    counts = [0, 1, 2, 5, 20, 170, 5000, 10**9]
    found = spark.createDataFrame([(n,) for n in counts], "n bigint").select("n", log_factorial(F.col("n")).alias("l")).collect()
    for row in found:
        assert row.l == pytest.approx(math.lgamma(row.n + 1), rel=1e-12, abs=1e-11)
