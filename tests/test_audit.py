"""Policy, sessions, calibration, rules, split: literals, guards, and changes that must not matter."""

from __future__ import annotations

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keyvigil.functions.calendar import EVALUATED, WARMUP
from keyvigil.operators import calibration, campaign, partition, policy, rules, sessions
from keyvigil.schemas import ATTRIBUTES, LOG, MAGNITUDE_ATTRIBUTES, OPERATORS, RULE_COLUMNS


@pytest.fixture(scope="module")
def repository(spark):
    keys = spark.createDataFrame(
        [("k1", "own", "active"), ("k2", "own", "disabled"), ("k3", "foreign", "active"), ("k4", "foreign", "disabled")],
        "key_id string, scope string, status string",
    )
    operators = spark.createDataFrame(
        [("o1", "end_user", ["own"], "routine", ["10.0.0.1"]), ("o2", "administrator", ["own", "foreign"], "occasional_custody", ["10.0.0.2"])],
        OPERATORS,
    )
    return keys, operators


def test_first_match_decides(spark, repository):
    keys, operators = repository
    requests = spark.createDataFrame(
        [("e1", "o1", "k9"), ("e2", "o1", "k4"), ("e3", "o1", "k3"), ("e4", "o1", "k2"), ("e5", "o1", "k1"), ("e6", "o2", "k3")],
        "event_id string, operator_id string, key_id string",
    )
    found = policy.outcomes(requests, keys, policy.grants_of(operators)).orderBy("event_id").collect()
    assert [row.outcome for row in found] == [
        "unknown_key", "denied_by_policy", "denied_by_policy", "disabled_key", "success", "success",
    ]


def test_unknown_operator_matters_only_for_known_keys(spark, repository):
    keys, operators = repository
    schema = "event_id string, operator_id string, key_id string"
    policy.require_known_operators(spark.createDataFrame([("e1", "ghost", "k9"), ("e2", "o1", "k1")], schema), operators, keys)
    with pytest.raises(KeyError, match="ghost"):
        policy.require_known_operators(spark.createDataFrame([("e1", "ghost", "k1")], schema), operators, keys)


def test_reach_and_its_complement(spark, repository):
    keys, operators = repository
    grants = policy.grants_of(operators)
    counts = {row.operator_id: (row.in_reach, row.out_of_reach) for row in policy.reach_counts(grants, keys).collect()}
    assert counts == {"o1": (2, 2), "o2": (4, 0)}
    assert sorted(policy.out_of_reach(operators, keys).collect()) == [("o1", "k3"), ("o1", "k4")]
    assert policy.reach(grants, keys).count() == 6
    assert policy.scopes_without_holder(keys, grants).count() == 0


def _moment(text):
    return datetime.fromisoformat(f"2024-01-{text}")


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("e2", "s1", "o1", _moment("02T09:00:00"), "a", "Decrypt", "k1", "success"),
        ("e1", "s1", "o1", _moment("02T09:00:00"), "b", "Decrypt", "k2", "denied_by_policy"),
        ("e3", "s1", "o1", _moment("02T09:30:00"), "a", "Decrypt", "k1", "unknown_key"),
        ("e4", "s2", "o1", _moment("03T18:00:00"), "c", "Decrypt", "k1", "success"),
    ]
    return spark.createDataFrame(rows, LOG).withColumn("seed", F.lit(1).cast("bigint"))


def test_session_takes_the_earliest_event(log):
    rows = {row.session_id: row for row in sessions.with_rates(sessions.per_session(log)).collect()}
    first = rows["s1"]
    # Two events share the first second; the lower event id is the opening.
    assert (first.source_ip, first.events, first.distinct_keys, first.failures, first.denials) == ("b", 3, 2, 2, 1)
    assert (first.duration_minutes, first.requests_per_minute) == (30.0, 0.1)
    assert (first.failures_per_event, first.denials_per_event) == (0.6667, 0.3333)
    # No duration: the pace is taken over one second.
    assert rows["s2"].requests_per_minute == 60.0


def test_row_order_does_not_matter(spark, log):
    shuffled = spark.createDataFrame(list(reversed(log.collect())), log.schema)
    assert sorted(sessions.per_session(log).collect()) == sorted(sessions.per_session(shuffled).collect())


def test_profile_and_history(spark, log):
    opened = sessions.openings(log)
    profile = sessions.profiles(opened).first()
    assert (profile.window_opens_at, profile.window_closes_at) == ("09:00:00", "18:00:00")
    assert (profile.observed_ips, profile.session_count) == (["b", "c"], 2)
    assert sessions.window_width_hours(sessions.profiles(opened)).first().width_hours == 9.0
    fresh = spark.createDataFrame(
        [
            (1, "x1", "o1", "b", _moment("20T09:00:00")),
            (1, "x2", "o1", "z", _moment("20T08:59:59")),
            (1, "x3", "o9", "b", _moment("20T10:00:00")),
        ],
        "seed bigint, session_id string, operator_id string, source_ip string, opened_at timestamp_ntz",
    )
    both = sessions.with_profile_cells(fresh, sessions.profiles(opened)).orderBy("session_id").collect()
    assert [(row.atypical_hour, row.new_source_ip) for row in both] == [(0, 0), (1, 1), (1, 1)]  # a stranger has no habits
    with pytest.raises(KeyError, match="o9"):
        sessions.require_profiles(fresh, sessions.usual_windows(opened))


def test_label_belongs_to_the_evaluated_phase(spark, log):
    windows, sources = sessions.usual_windows(sessions.openings(log)), sessions.seen_sources(sessions.openings(log))
    marks = spark.createDataFrame([(1, "s2"), (1, "s2"), (2, "s1")], "seed bigint, session_id string")
    built = sessions.session_table(log, windows, sources, EVALUATED, marks)
    assert tuple(built.columns) == ("seed", *sessions.columns_of(EVALUATED))
    assert {row.session_id: row.compromised for row in built.collect()} == {"s1": 0, "s2": 1}
    with pytest.raises(ValueError, match="needs the table"):
        sessions.session_table(log, windows, sources, EVALUATED)
    with pytest.raises(ValueError, match="does not belong"):
        sessions.session_table(log, windows, sources, WARMUP, marks)
    with pytest.raises(ValueError, match="no label"):
        sessions.require_label(sessions.session_table(log, windows, sources, WARMUP))


def _attribute_rows(spark, rows):
    kinds = ", ".join(f"{name} double" for name in ATTRIBUTES)
    return spark.createDataFrame(rows, f"seed bigint, session_id string, operator_id string, opened_at string, {kinds}, compromised int")


def _cut_table(spark, names=MAGNITUDE_ATTRIBUTES):
    return spark.createDataFrame([(1, name, 10.0, 99, 1000) for name in names], "seed bigint, attribute string, threshold double, percentile int, sessions bigint")


def test_two_rules_alert_and_one_does_not(spark):
    rows = [(1, "quiet", "o", "t", *[10.0] * 6, 0.0, 0.0, 0)]
    loud = {name: (10.0001 if name in MAGNITUDE_ATTRIBUTES else 1.0) for name in ATTRIBUTES}
    for count in (1, 2):
        for chosen in itertools.combinations(ATTRIBUTES, count):
            values = [loud[name] if name in chosen else 0.0 for name in ATTRIBUTES]
            rows.append((1, "+".join(chosen), "o", "t", *values, 0))
    found = {row.session_id: row for row in rules.rule_predictions(_attribute_rows(spark, rows), _cut_table(spark)).collect()}
    assert found["quiet"].rules_fired == 0 and found["quiet"].predicted == 0
    for name, row in found.items():
        if name != "quiet":
            chosen = name.split("+")
            assert [getattr(row, column) for column in RULE_COLUMNS] == [int(a in chosen) for a in ATTRIBUTES]
            assert row.predicted == int(len(chosen) == 2)


def test_threshold_set_is_checked(spark):
    calibration.require_threshold_set(_cut_table(spark))
    with pytest.raises(ValueError, match="events"):
        calibration.require_threshold_set(_cut_table(spark, MAGNITUDE_ATTRIBUTES[1:]))


def test_approximate_thresholds_stay_near_the_exact_ones(spark):
    rows = [(1, f"s{i}", "o", "t", *[float(i)] * 6, 0.0, 0.0, 0) for i in range(1000)]
    table = _attribute_rows(spark, rows)
    exact = {row.attribute: row.threshold for row in calibration.thresholds(table).collect()}
    near = {row.attribute: row.threshold for row in calibration.thresholds(table, method="approximate").collect()}
    assert exact["events"] == pytest.approx(989.01)
    assert all(abs(exact[name] - near[name]) <= 2 for name in exact)


def _labelled(spark, sigma, shift):
    rows = []
    for i in range(120):
        label = int(i % 10 == 0)
        # The campaign changes ids, openings and attributes with sigma; legitimate sessions stay.
        rows.append((1, sigma, f"s{(i * 7 + (shift if label else 0)) % 1000:04d}-{i}", f"o{i % 5}",
                     f"2024-01-{15 + i % 10:02d}T{(i + (shift if label else 0)) % 24:02d}:00:00", *[float(i + shift * label)] * 8, label))
    kinds = ", ".join(f"{name} double" for name in ATTRIBUTES)
    return spark.createDataFrame(rows, f"seed bigint, sigma double, session_id string, operator_id string, opened_at string, {kinds}, compromised int")


def test_split_is_the_same_in_every_condition(spark):
    both = _labelled(spark, 0.0, 0).unionByName(_labelled(spark, 1.0, 5))
    table = partition.split(both, ("seed", "sigma"))
    held = {
        (row.sigma, row.compromised): row.positions
        for row in table.where("side = 'holdout'").groupBy("sigma", "compromised")
        .agg(F.sort_array(F.collect_list("position")).alias("positions")).collect()
    }
    assert held[(0.0, 0)] == held[(1.0, 0)] and len(held[(0.0, 0)]) == 43
    assert held[(0.0, 1)] == held[(1.0, 1)] and len(held[(0.0, 1)]) == 5
    ids = table.where("side = 'holdout' AND compromised = 0").groupBy("sigma").agg(F.sort_array(F.collect_list("session_id")).alias("ids")).collect()
    assert ids[0].ids == ids[1].ids


def test_split_does_not_depend_on_how_rows_are_cut(spark):
    table = _labelled(spark, 0.0, 0).drop("sigma")
    key = ["session_id", "position", "side"]
    few = sorted(partition.split(table).select(*key).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert few == sorted(partition.split(table).select(*key).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_split_ignores_row_order_and_attributes(spark):
    table = _labelled(spark, 0.0, 0).drop("sigma")
    blank = table.orderBy(F.rand(3)).withColumns({name: F.lit(0.0) for name in ATTRIBUTES})
    key = ["session_id", "position", "side"]
    assert sorted(partition.split(table).select(*key).collect()) == sorted(partition.split(blank).select(*key).collect())


def test_duplicates_count_rows_and_ids(spark):
    kinds = ", ".join(f"{name} double" for name in ATTRIBUTES)
    rows = [(1, "a", "train", *[1.0] * 8), (1, "b", "train", *[2.0] * 8), (1, "a", "holdout", *[3.0] * 8),
            (1, "c", "holdout", *[2.0] * 8), (1, "d", "holdout", *[2.0] * 8)]
    table = spark.createDataFrame(rows, f"seed bigint, session_id string, side string, {kinds}")
    assert tuple(partition.duplicates(table).first()) == (1, 1, 2)


def test_campaign_is_merged_without_a_mark(spark):
    schema = "seed bigint, timestamp timestamp_ntz, session_id string, event_id string, operator_id string"
    calm = spark.createDataFrame([(1, _moment("15T10:00:00"), "z", "e1", "o1"), (1, _moment("15T12:00:00"), "z", "e2", "o1"),
                                  (1, _moment("16T10:00:00"), "y", "e3", "o2")], schema)
    attack = spark.createDataFrame([(1, _moment("15T11:00:00"), "attack", "x1", "o2")], schema)
    traffic, labels = campaign.merged(calm, attack)
    numbers = [(row.event_number, row.session_number) for row in traffic.orderBy("position").collect()]
    assert numbers == [("event_000001", "session_00001"), ("event_000002", "session_00002"),
                       ("event_000003", "session_00001"), ("event_000004", "session_00003")]
    assert [tuple(row) for row in labels.collect()] == [(1, "session_00002")]
    assert "_campaign" not in traffic.columns
