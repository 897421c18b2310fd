"""The SQL each registered query is checked against, written on its own for another engine.

Every statement is the adapter of the test tables as CTEs, then the operator in plain SQL.
"""

from __future__ import annotations

import re

from keyvigil.schemas import ATTRIBUTES, DECLARED_MIX, MAGNITUDE_ATTRIBUTES, OPERATIONS

_IDENTIFIERS = ("session_id", "operator_id", "opened_at")

CTES: dict[str, str] = {}

CTES["k_events"] = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
       CAST(extract(DAY FROM ts) - 1 AS BIGINT) AS day_no,
       CAST(floor((extract(DAY FROM ts) - 1) / 2) AS BIGINT) AS block
FROM events"""
CTES["a_keys"] = """
SELECT DISTINCT concat('k_', lpad(CAST(k AS STRING), 3, '0')) AS key_id,
       concat('scope_', lpad(CAST(k % 10 + 1 AS STRING), 2, '0')) AS scope,
       CASE WHEN k % 20 = 7 THEN 'disabled' ELSE 'active' END AS status
FROM k_events WHERE k < 95"""
CTES["a_operators"] = """
SELECT DISTINCT user_id, concat('op_', lpad(CAST(user_id AS STRING), 6, '0')) AS operator_id,
       CAST(user_id % 10 + 1 AS BIGINT) AS seed,
       CASE WHEN user_id % 11 IN (0, 1) THEN 'administrator' WHEN user_id % 11 = 2 THEN 'automated_service'
            ELSE 'end_user' END AS profile,
       CASE WHEN user_id % 11 IN (0, 1) THEN 'occasional_custody' WHEN user_id % 11 = 2 THEN 'periodic_batch'
            ELSE 'routine' END AS regime
FROM k_events"""
CTES["a_addresses"] = """
SELECT operator_id, n AS position,
       concat('10.', CAST(user_id % 256 AS STRING), '.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING), '.',
              CAST(n AS STRING)) AS source_ip
FROM a_operators, (SELECT unnest([1, 2, 3, 4]) AS n)"""
CTES["a_grants"] = """
SELECT o.operator_id, s.scope
FROM a_operators o CROSS JOIN (SELECT DISTINCT scope FROM a_keys) s
WHERE CAST(substr(s.scope, 7, 2) AS BIGINT) - 1 <> o.user_id % 10
  AND NOT (o.profile = 'automated_service' AND CAST(substr(s.scope, 7, 2) AS BIGINT) - 1 = (o.user_id + 3) % 10)"""
CTES["a_requests"] = """
SELECT concat('event_', lpad(CAST(event_id AS STRING), 9, '0')) AS event_id,
       concat('s_', lpad(CAST(user_id AS STRING), 6, '0'), '_', lpad(CAST(block AS STRING), 2, '0')) AS session_id,
       concat('op_', lpad(CAST(user_id AS STRING), 6, '0')) AS operator_id,
       ts,
       concat('10.', CAST(user_id % 256 AS STRING), '.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING), '.',
              CASE (user_id * 31 + block * 17) % 10 WHEN 9 THEN CAST(3 + block % 2 AS STRING) WHEN 8 THEN '2'
                   WHEN 7 THEN '2' ELSE '1' END) AS source_ip,
       CASE event_type WHEN 'purchase' THEN 'Encrypt' WHEN 'view' THEN 'DescribeKey'
            WHEN 'signup' THEN 'ExportKeyMaterial' ELSE 'Decrypt' END AS operation,
       concat('k_', lpad(CAST(k AS STRING), 3, '0')) AS key_id,
       day_no, event_type, CAST(user_id % 10 + 1 AS BIGINT) AS seed
FROM k_events"""
CTES["a_log"] = """
SELECT r.event_id, r.session_id, r.operator_id, r.ts, r.source_ip, r.operation, r.key_id, r.seed, r.event_type,
       CASE WHEN k.key_id IS NULL THEN 'unknown_key' WHEN g.scope IS NULL THEN 'denied_by_policy'
            WHEN k.status = 'disabled' THEN 'disabled_key' ELSE 'success' END AS outcome,
       CASE WHEN r.day_no < 14 THEN 'warmup' WHEN r.day_no < 28 THEN 'evaluated' END AS phase
FROM a_requests r
LEFT JOIN a_keys k ON r.key_id = k.key_id
LEFT JOIN a_grants g ON r.operator_id = g.operator_id AND k.scope = g.scope"""
CTES["a_labels"] = """
SELECT l.session_id
FROM a_log l JOIN a_operators o ON l.operator_id = o.operator_id
WHERE l.phase = 'evaluated' AND o.profile = 'administrator'
GROUP BY l.session_id HAVING sum(CASE WHEN l.event_type = 'error' THEN 1 ELSE 0 END) >= 2"""
CTES["a_scored"] = """
SELECT l.seed, l.session_id, min(l.operator_id) AS operator_id, count(*) AS events,
       count(DISTINCT l.key_id) AS distinct_keys,
       sum(CASE WHEN l.outcome <> 'success' THEN 1 ELSE 0 END) AS failures,
       max(CASE WHEN b.session_id IS NULL THEN 0 ELSE 1 END) AS compromised
FROM a_log l LEFT JOIN a_labels b ON l.session_id = b.session_id
WHERE l.phase = 'evaluated' GROUP BY l.seed, l.session_id"""
CTES["a_predictions"] = """
SELECT s.seed, c.sigma, s.session_id, s.operator_id, m.mechanism, s.compromised,
       CASE m.mechanism WHEN 'model_a' THEN s.events / (s.events + 4.0E0 + 8.0E0 * c.sigma)
                        WHEN 'model_b' THEN s.distinct_keys / (s.distinct_keys + 5.0E0 + 4.0E0 * c.sigma) END AS score,
       CASE m.mechanism WHEN 'rules' THEN CASE WHEN s.failures >= 2 AND s.events >= 5 THEN 1 ELSE 0 END
                        WHEN 'model_a' THEN CASE WHEN s.events >= 4.0E0 + 8.0E0 * c.sigma THEN 1 ELSE 0 END
                        ELSE CASE WHEN s.distinct_keys >= 5.0E0 + 4.0E0 * c.sigma THEN 1 ELSE 0 END END AS predicted
FROM a_scored s
CROSS JOIN (SELECT 0.0E0 AS sigma UNION ALL SELECT 0.5E0 UNION ALL SELECT 1.0E0) c
CROSS JOIN (SELECT 'rules' AS mechanism UNION ALL SELECT 'model_a' UNION ALL SELECT 'model_b') m"""
CTES["a_timings"] = """
SELECT CASE user_id % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'model_a' ELSE 'model_b' END AS mechanism,
       value AS microseconds_per_session, 1.0E6 / value AS sessions_per_second
FROM k_events WHERE value > 0"""

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
OPENED = _ISO.format("opened_at") + " AS opened_at"

CTES["o_base"] = """
SELECT seed, phase, session_id, first(operator_id ORDER BY ts, event_id) AS operator_id,
       first(source_ip ORDER BY ts, event_id) AS source_ip, min(ts) AS opened_at, max(ts) AS closed_at,
       count(*) AS events, count(DISTINCT key_id) AS distinct_keys,
       count(*) FILTER (WHERE outcome <> 'success') AS failures,
       count(*) FILTER (WHERE outcome = 'denied_by_policy') AS denials
FROM a_log WHERE phase IS NOT NULL GROUP BY seed, phase, session_id"""
CTES["o_whole"] = """
SELECT seed, session_id, first(operator_id ORDER BY ts, event_id) AS operator_id,
       first(source_ip ORDER BY ts, event_id) AS source_ip, min(ts) AS opened_at, max(ts) AS closed_at,
       count(*) AS events, count(DISTINCT key_id) AS distinct_keys,
       count(*) FILTER (WHERE outcome <> 'success') AS failures,
       count(*) FILTER (WHERE outcome = 'denied_by_policy') AS denials
FROM a_log GROUP BY seed, session_id"""
_RATED = """
SELECT *, round_even(m, 4) AS duration_minutes,
       round_even(events / greatest(m, 1.0E0 / 60), 4) AS requests_per_minute,
       round_even(failures / events, 4) AS failures_per_event,
       round_even(denials / events, 4) AS denials_per_event
FROM (SELECT *, (epoch_us(closed_at) - epoch_us(opened_at)) / 6.0E7 AS m FROM {0})"""
CTES["o_rated"] = _RATED.format("o_base")
CTES["o_whole_rated"] = _RATED.format("o_whole")
CTES["o_profiles"] = """
SELECT seed, operator_id, min(strftime(opened_at, '%H:%M:%S')) AS window_opens_at,
       max(strftime(opened_at, '%H:%M:%S')) AS window_closes_at,
       string_agg(DISTINCT source_ip, '|' ORDER BY source_ip) AS observed_ips, count(*) AS session_count
FROM o_base WHERE phase = 'warmup' GROUP BY seed, operator_id"""
_HISTORY = """
SELECT r.*,
       CAST(NOT (strftime(r.opened_at, '%H:%M:%S') BETWEEN p.window_opens_at AND p.window_closes_at) AS INTEGER)
           AS atypical_hour,
       CAST(NOT list_contains(string_split(p.observed_ips, '|'), r.source_ip) AS INTEGER) AS new_source_ip
FROM {0} r LEFT JOIN o_profiles p ON r.seed = p.seed AND r.operator_id = p.operator_id"""
# A stranger has no usual hour and no usual source.
_HISTORY = _HISTORY.replace("CAST(NOT (", "CAST(coalesce(NOT (").replace("p.window_closes_at) AS INTEGER)", "p.window_closes_at), true) AS INTEGER)")
_HISTORY = _HISTORY.replace("CAST(NOT list_contains(", "CAST(coalesce(NOT list_contains(").replace("r.source_ip) AS INTEGER)", "r.source_ip), true) AS INTEGER)")
CTES["o_sessions"] = _HISTORY.format("o_rated")
CTES["o_whole_sessions"] = _HISTORY.format("o_whole_rated")
CTES["o_eval"] = """
SELECT s.*, CASE WHEN b.session_id IS NULL THEN 0 ELSE 1 END AS compromised
FROM o_sessions s LEFT JOIN a_labels b ON s.session_id = b.session_id WHERE s.phase = 'evaluated'"""


def _long(source: str, keep: str, attributes: tuple[str, ...]) -> str:
    parts = [
        f"SELECT {keep}, '{name}' AS attribute, {place} AS place, CAST({name} AS DOUBLE) AS value FROM {source}"
        for place, name in enumerate(attributes)
    ]
    return " UNION ALL ".join(parts)


CTES["o_warm_long"] = _long("o_rated", "seed, phase", MAGNITUDE_ATTRIBUTES)
CTES["o_thresholds"] = """
SELECT seed, attribute, round_even(quantile_cont(value, 0.99), 4) AS threshold, 99 AS percentile, count(*) AS sessions
FROM o_warm_long WHERE phase = 'warmup' GROUP BY seed, attribute"""
CTES["o_cutoffs"] = (
    "SELECT seed, "
    + ", ".join(f"max(threshold) FILTER (WHERE attribute = '{a}') AS cutoff_{a}" for a in MAGNITUDE_ATTRIBUTES)
    + " FROM o_thresholds GROUP BY seed"
)


def _flags(source: str) -> str:
    flags = [f"CAST({a} > cutoff_{a} AS INTEGER) AS rule_{a}" for a in MAGNITUDE_ATTRIBUTES]
    flags += [f"CAST({a} = 1 AS INTEGER) AS rule_{a}" for a in ATTRIBUTES[6:]]
    total = " + ".join(f"rule_{a}" for a in ATTRIBUTES)
    return (
        f"SELECT *, CAST(rules_fired >= 2 AS INTEGER) AS predicted FROM (SELECT *, {total} AS rules_fired FROM "
        f"(SELECT s.*, {', '.join(flags)} FROM {source} s JOIN o_cutoffs c ON s.seed = c.seed))"
    )


CTES["o_alerts"] = _flags("o_eval")
CTES["o_whole_alerts"] = _flags("o_whole_sessions")
CTES["g_log"] = """
SELECT l.*, c.sigma FROM a_log l LEFT JOIN a_labels b ON l.session_id = b.session_id
CROSS JOIN (SELECT unnest([0.0E0, 0.5E0, 1.0E0]) AS sigma) c
WHERE l.phase = 'evaluated' AND (b.session_id IS NULL OR CAST(substr(l.event_id, 7, 9) AS BIGINT) % 4 >= 2 * c.sigma)"""
CTES["g_base"] = CTES["o_base"].replace("SELECT seed, phase", "SELECT seed, sigma").replace(
    "FROM a_log WHERE phase IS NOT NULL GROUP BY seed, phase", "FROM g_log GROUP BY seed, sigma")
CTES["g_rated"] = _RATED.format("g_base")
CTES["g_sessions"] = _HISTORY.format("g_rated")
CTES["g_eval"] = """
SELECT s.*, CASE WHEN b.session_id IS NULL THEN 0 ELSE 1 END AS compromised
FROM g_sessions s LEFT JOIN a_labels b ON s.session_id = b.session_id"""
CTES["g_alerts"] = _flags("g_eval")
CTES["g_split"] = """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY seed, sigma, compromised ORDER BY md5(concat_ws('|', CAST(seed AS STRING),
       CAST(compromised AS STRING), CAST(position AS STRING)))) <= holdout THEN 'holdout' ELSE 'train' END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY seed, sigma, compromised ORDER BY opened_at, operator_id, session_id) AS position,
       CAST(floor(count(*) OVER (PARTITION BY seed, sigma, compromised) * 0.4E0 + 0.5E0) AS BIGINT) AS holdout FROM g_alerts)"""
CTES["o_placed"] = """
SELECT *, row_number() OVER (PARTITION BY seed, compromised ORDER BY opened_at, operator_id, session_id) AS position,
       row_number() OVER (PARTITION BY seed, compromised, operator_id, opened_at ORDER BY session_id) - 1 AS tie,
       CAST(floor(count(*) OVER (PARTITION BY seed, compromised) * 0.4E0 + 0.5E0) AS BIGINT) AS holdout
FROM o_alerts"""
CTES["o_split"] = """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY seed, compromised ORDER BY md5(concat_ws('|', CAST(seed AS STRING),
       CAST(compromised AS STRING), CAST(position AS STRING)))) <= holdout THEN 'holdout' ELSE 'train' END AS side
FROM o_placed"""


def _confusion(truth: str = "compromised", decided: str = "predicted") -> str:
    cells = (
        ("true_positives", 1, 1), ("false_positives", 0, 1), ("true_negatives", 0, 0), ("false_negatives", 1, 0)
    )
    return ", ".join(
        f"count(*) FILTER (WHERE {truth} = {actual} AND {decided} = {said}) AS {name}" for name, actual, said in cells
    )


_F1 = "2.0E0 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0)"
_PRECISION = (
    "CASE WHEN true_positives + false_positives = 0 THEN 0.0E0 "
    "ELSE true_positives / CAST(true_positives + false_positives AS DOUBLE) END"
)
_RECALL = "true_positives / nullif(CAST(true_positives + false_negatives AS DOUBLE), 0)"
_ACCURACY = (
    "(true_positives + true_negatives) / "
    "nullif(CAST(true_positives + false_positives + true_negatives + false_negatives AS DOUBLE), 0)"
)
_SPECIFICITY = "true_negatives / nullif(CAST(true_negatives + false_positives AS DOUBLE), 0)"
_ALL_RATES = {
    "f1": _F1, "precision": _PRECISION, "recall": _RECALL, "accuracy": _ACCURACY, "specificity": _SPECIFICITY
}
_RATES = ", ".join(f"round_even({text}, 4) AS {name}" for name, text in _ALL_RATES.items())


def _auc(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, round_even((sum(midrank) FILTER (WHERE compromised = 1)
           - count(*) FILTER (WHERE compromised = 1) * (count(*) FILTER (WHERE compromised = 1) + 1) / 2.0E0)
       / nullif(CAST(count(*) FILTER (WHERE compromised = 1) * count(*) FILTER (WHERE compromised = 0) AS DOUBLE), 0), 4)
           AS roc_auc
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score)
                + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0E0 AS midrank
      FROM {source} WHERE score IS NOT NULL)
GROUP BY {keys}"""


CTES["o_scoped"] = """
SELECT p.*, 'all' AS scope FROM a_predictions p
UNION ALL
SELECT p.*, 'administrators' AS scope FROM a_predictions p
WHERE p.operator_id IN (SELECT operator_id FROM a_operators WHERE profile = 'administrator')"""
CTES["o_areas"] = _auc("o_scoped", "seed, sigma, mechanism, scope")
CTES["o_counted"] = (
    "SELECT seed, sigma, mechanism, scope, count(*) AS sessions, "
    f"count(*) FILTER (WHERE compromised = 1) AS positives, {_confusion()} "
    "FROM o_scoped GROUP BY seed, sigma, mechanism, scope"
)
CTES["o_metrics"] = f"""
SELECT c.*, {_RATES}, a.roc_auc
FROM o_counted c LEFT JOIN o_areas a
  ON c.seed = a.seed AND c.sigma = a.sigma AND c.mechanism = a.mechanism AND c.scope = a.scope"""
CTES["o_median_f1"] = """
SELECT sigma, scope, mechanism, round_even(quantile_cont(f1, 0.5), 4) AS median_f1, count(f1) AS seeds
FROM o_metrics GROUP BY sigma, scope, mechanism"""
CTES["o_differences"] = """
SELECT m.seed, m.sigma, m.mechanism AS model, m.f1 - r.f1 AS difference
FROM o_metrics m JOIN o_metrics r ON m.seed = r.seed AND m.sigma = r.sigma AND m.scope = r.scope
WHERE m.scope = 'all' AND m.mechanism <> 'rules' AND r.mechanism = 'rules' AND m.f1 - r.f1 IS NOT NULL"""

# Signed ranks: average ranks of the absolute differences, then the exact law from a recursive count of rank sums, or
# the normal law with the tie term.
CTES["o_ranked"] = """
SELECT sigma, model, difference, rank() OVER (PARTITION BY sigma, model ORDER BY abs(difference))
       + (count(*) OVER (PARTITION BY sigma, model, abs(difference)) - 1) / 2.0E0 AS r,
       count(*) OVER (PARTITION BY sigma, model, abs(difference)) AS t
FROM o_differences WHERE difference <> 0"""
CTES["o_rank_sums"] = """
SELECT d.sigma, d.model, d.pairs, coalesce(r.n, 0) AS n, coalesce(r.up, 0) AS up, coalesce(r.down, 0) AS down,
       coalesce(r.tie_term, 0) AS tie_term, least(coalesce(r.up, 0), coalesce(r.down, 0)) AS w
FROM (SELECT sigma, model, count(*) AS pairs FROM o_differences GROUP BY sigma, model) d
LEFT JOIN (SELECT sigma, model, count(*) AS n, sum(CASE WHEN difference > 0 THEN r ELSE 0 END) AS up,
                  sum(CASE WHEN difference < 0 THEN r ELSE 0 END) AS down,
                  sum(CAST(t * t - 1 AS DOUBLE)) AS tie_term
           FROM o_ranked GROUP BY sigma, model) r ON d.sigma = r.sigma AND d.model = r.model"""
CTES["o_subset_sums"] = """
SELECT n, s, c FROM (
  WITH RECURSIVE sums(n, s, c) AS (
    SELECT 0, 0, 1.0E0
    UNION ALL
    SELECT n + 1, s2, sum(c2) OVER (PARTITION BY n + 1, s2)
    FROM (SELECT n, s AS s2, c AS c2 FROM sums WHERE n < 50 UNION ALL SELECT n, s + n + 1, c FROM sums WHERE n < 50)
    QUALIFY row_number() OVER (PARTITION BY n + 1, s2) = 1)
  SELECT n, s, c FROM sums)"""
CTES["o_tested"] = """
SELECT t.sigma, t.model, t.pairs,
       CASE WHEN t.pairs < 2 THEN NULL WHEN t.n = 0 THEN 0.0E0 ELSE t.w END AS statistic,
       CASE WHEN t.pairs < 2 THEN NULL WHEN t.n = 0 THEN 1.0E0
            WHEN t.n <= 50 AND t.n = t.pairs AND t.tie_term = 0 THEN
              least(1.0E0, 2 * (SELECT sum(c) FROM o_subset_sums q WHERE q.n = t.n AND q.s <= t.w) / pow(2.0E0, t.n))
            WHEN x = 0 THEN 1.0E0
            -- The tail integral over the density, by Simpson's rule on 4,000 steps.
            ELSE 2 / sqrt(2 * pi()) * exp(-x * x) * 0.01E0 / 3 * list_sum(list_transform(range(0, 4001),
                 lambda k: (CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                   * exp(-x * sqrt(2.0E0) * k * 0.01E0 - (k * 0.01E0) * (k * 0.01E0) / 2))) END AS p_value
FROM (SELECT *, abs(w - n * (n + 1) / 4.0E0) / nullif(sqrt(n * (n + 1.0E0) * (2 * n + 1) / 24 - tie_term / 48), 0)
                / sqrt(2.0E0) AS x FROM o_rank_sums) t"""

CTES["o_train_values"] = _long("o_split", "seed, compromised, side", ATTRIBUTES)
CTES["o_cut_values"] = """
SELECT seed, attribute, place, value, sum(n) OVER below AS left_rows, sum(p) OVER below AS left_positives,
       lead(value) OVER (PARTITION BY seed, attribute ORDER BY value) AS next_value,
       sum(n) OVER (PARTITION BY seed, attribute) AS all_rows, sum(p) OVER (PARTITION BY seed, attribute) AS all_positives
FROM (SELECT seed, attribute, place, value, count(*) AS n, sum(compromised) AS p FROM o_train_values
      WHERE side = 'train' GROUP BY seed, attribute, place, value)
WINDOW below AS (PARTITION BY seed, attribute ORDER BY value)"""
CTES["o_cuts"] = """
SELECT * FROM (
  SELECT seed, attribute, (value + next_value) / 2 AS threshold,
         CAST(left_positives * 2 > left_rows AS INTEGER) AS below,
         CAST((all_positives - left_positives) * 2 > all_rows - left_rows AS INTEGER) AS above,
         row_number() OVER (PARTITION BY seed ORDER BY
           round_even(2.0E0 * left_positives * (left_rows - left_positives) / left_rows
             + 2.0E0 * (all_positives - left_positives) * (all_rows - left_rows - all_positives + left_positives)
               / (all_rows - left_rows), 9), place, value) AS choice
  FROM o_cut_values WHERE next_value IS NOT NULL AND all_positives > 0 AND all_positives < all_rows)
WHERE choice = 1"""
_CHOSEN = "CASE c.attribute " + " ".join(f"WHEN '{a}' THEN CAST(s.{a} AS DOUBLE)" for a in ATTRIBUTES) + " END"
CTES["o_stump"] = f"""
SELECT seed, coalesce(max(attribute), '') AS stump_attribute, round_even(max(threshold), 4) AS stump_threshold,
       round_even(2.0E0 * count(*) FILTER (WHERE compromised = 1 AND said = 1)
         / nullif(2 * count(*) FILTER (WHERE compromised = 1 AND said = 1)
                  + count(*) FILTER (WHERE compromised <> said), 0), 4) AS stump_f1
FROM (SELECT s.seed, s.compromised, c.attribute, c.threshold,
             coalesce(CASE WHEN {_CHOSEN} <= c.threshold THEN c.below WHEN {_CHOSEN} > c.threshold THEN c.above END, 0)
               AS said
      FROM o_split s LEFT JOIN o_cuts c ON s.seed = c.seed WHERE s.side = 'holdout')
GROUP BY seed"""
CTES["o_comparison_raw"] = """
SELECT t.sigma, t.model, t.pairs AS seeds, d.median_difference, d.q1_difference, d.q3_difference,
       t.statistic, round_even(t.p_value, 6) AS p_value, u.stump AS stump, u.stump >= 0.95 AS excluded
FROM o_tested t
JOIN (SELECT sigma, model, round_even(quantile_cont(difference, 0.5), 4) AS median_difference,
             round_even(quantile_cont(difference, 0.25), 4) AS q1_difference,
             round_even(quantile_cont(difference, 0.75), 4) AS q3_difference
      FROM o_differences GROUP BY sigma, model) d ON t.sigma = d.sigma AND t.model = d.model
CROSS JOIN (SELECT quantile_cont(stump_f1, 0.5) AS stump FROM o_stump) u"""
CTES["o_comparison"] = """
SELECT r.sigma, r.model, r.seeds, ma.median_f1 AS median_f1_model, ra.median_f1 AS median_f1_rules,
       r.median_difference, r.q1_difference, r.q3_difference, r.statistic, r.p_value,
       round_even(r.stump, 4) AS stump_median_f1, coalesce(r.excluded, false) AS excluded, h.p_holm AS exact_holm,
       round_even(h.p_holm, 6) AS p_holm, coalesce(h.p_holm < 0.05, false) AS significant,
       mb.median_f1 AS median_f1_model_administrators, rb.median_f1 AS median_f1_rules_administrators
FROM o_comparison_raw r
LEFT JOIN (SELECT sigma, model, least(1.0E0, max(step) OVER (ORDER BY p_value, sigma, model
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm
           FROM (SELECT *, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, sigma, model) + 1) AS step
                 FROM o_comparison_raw WHERE p_value IS NOT NULL AND NOT coalesce(excluded, false))) h
  ON r.sigma = h.sigma AND r.model = h.model
LEFT JOIN o_median_f1 ma ON ma.sigma = r.sigma AND ma.mechanism = r.model AND ma.scope = 'all'
LEFT JOIN o_median_f1 ra ON ra.sigma = r.sigma AND ra.mechanism = 'rules' AND ra.scope = 'all'
LEFT JOIN o_median_f1 mb ON mb.sigma = r.sigma AND mb.mechanism = r.model AND mb.scope = 'administrators'
LEFT JOIN o_median_f1 rb ON rb.sigma = r.sigma AND rb.mechanism = 'rules' AND rb.scope = 'administrators'"""

CTES["o_holdout"] = """
SELECT *, row_number() OVER (PARTITION BY seed ORDER BY session_id) AS place FROM o_split WHERE side = 'holdout'"""


def _orders() -> str:
    """The permutations, one subselect per round: x and its partner change places if a bit of the larger one says so."""
    inner = """
SELECT h.seed, a.attribute, r.repeat, h.place AS from_place, count(*) OVER (PARTITION BY h.seed, a.attribute, r.repeat) AS n,
       (('0x' || substr(md5(CAST(h.seed AS VARCHAR)), 1, 7))::BIGINT * 31 + a.number * 104729 + r.repeat * 1299709) % 2147483647 AS k
FROM o_holdout h
CROSS JOIN (SELECT unnest([{names}]) AS attribute, unnest(range({count})) AS number) a
CROSS JOIN (SELECT unnest(range(1, 11)) AS repeat) r""".format(names=", ".join(f"'{a}'" for a in ATTRIBUTES), count=len(ATTRIBUTES))
    sql = f"""SELECT *, ((from_place - 1) * CASE WHEN n % 1000003 <> 0 THEN 1000003 ELSE 999983 END + k) % n AS x FROM ({inner})"""
    for i in range(1, 17):
        partner = (
            f"(((((k * 48271 + {i * 1299709}) % 2147483647) * 69621 % 2147483629) * 2147483647 + (k * 40692 + {i}) % 2147483629) % n - x + n) % n"
        )
        sql = f"""SELECT * EXCLUDE (x, y), CASE WHEN (((greatest(x, y) % 2147483647) * ((k * 69621 + {i * 40692}) % 2147483647 + 1)) % 2147483647)
            * 48271 % 2147483629 % 2 = 1 THEN y ELSE x END AS x FROM (SELECT *, {partner} AS y FROM ({sql}))"""
    return f"SELECT seed, attribute, repeat, from_place, x + 1 AS to_place FROM ({sql})"


CTES["o_orders"] = _orders()
_OWN = "CASE o.attribute " + " ".join(f"WHEN '{a}' THEN t.rule_{a}" for a in ATTRIBUTES) + " END"
_THEIRS = "CASE o.attribute " + " ".join(f"WHEN '{a}' THEN f.rule_{a}" for a in ATTRIBUTES) + " END"
CTES["o_importance"] = f"""
SELECT a.seed, 'rules' AS mechanism, a.attribute, round_even(b.f1 - a.f1, 4) + 0.0E0 AS f1_drop
FROM (SELECT seed, attribute, avg({_F1}) AS f1
      FROM (SELECT seed, attribute, repeat, {_confusion()}
            FROM (SELECT o.seed, o.attribute, o.repeat, t.compromised,
                         CAST(t.rules_fired - {_OWN} + {_THEIRS} >= 2 AS INTEGER) AS predicted
                  FROM o_orders o
                  JOIN o_holdout t ON o.seed = t.seed AND o.to_place = t.place
                  JOIN o_holdout f ON o.seed = f.seed AND o.from_place = f.place)
            GROUP BY seed, attribute, repeat)
      GROUP BY seed, attribute) a
JOIN (SELECT seed, {_F1} AS f1 FROM (SELECT seed, {_confusion()} FROM o_holdout GROUP BY seed)) b ON a.seed = b.seed"""

CTES["o_traffic"] = """
SELECT w.session_id, w.operator_id, w.opened_at, w.closed_at, w.events, w.source_ip, o.profile, o.regime,
       (epoch_us(w.closed_at) - epoch_us(w.opened_at)) / 6.0E7 AS minutes, w.source_ip = d.source_ip AS from_primary
FROM o_whole w JOIN a_operators o ON w.operator_id = o.operator_id
JOIN a_addresses d ON w.operator_id = d.operator_id AND d.position = 1"""
CTES["o_business_days"] = """
SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-28',
  INTERVAL 1 DAY)) AS day) WHERE isodow(day) < 6"""
CTES["o_daily"] = """
SELECT o.operator_id, o.regime, d.day, count(t.session_id) AS sessions
FROM a_operators o CROSS JOIN o_business_days d
LEFT JOIN o_traffic t ON t.operator_id = o.operator_id AND CAST(t.opened_at AS DATE) = d.day
GROUP BY o.operator_id, o.regime, d.day"""
CTES["o_size_share"] = """
SELECT g.regime, g.events, coalesce(n.n, 0) / CAST(g.total AS DOUBLE) AS share
FROM (SELECT regime, total, unnest(range(1, biggest + 1)) AS events
      FROM (SELECT regime, max(events) AS biggest, count(*) AS total FROM o_traffic GROUP BY regime)) g
LEFT JOIN (SELECT regime, events, count(*) AS n FROM o_traffic GROUP BY regime, events) n
  ON g.regime = n.regime AND g.events = n.events"""
CTES["o_day_share"] = """
SELECT g.regime, g.sessions, coalesce(n.n, 0) / CAST(g.total AS DOUBLE) AS share
FROM (SELECT regime, total, unnest(range(0, greatest(8, biggest) + 1)) AS sessions
      FROM (SELECT regime, max(sessions) AS biggest, count(*) AS total FROM o_daily GROUP BY regime)) g
LEFT JOIN (SELECT regime, sessions, count(*) AS n FROM o_daily GROUP BY regime, sessions) n
  ON g.regime = n.regime AND g.sessions = n.sessions"""
CTES["o_events_placed"] = """
SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ts, session_id, event_id) AS position FROM a_requests"""
CTES["o_folds"] = """
SELECT p.*, r.repeat, CAST((row_number() OVER (PARTITION BY p.sigma, p.mechanism, r.repeat, p.compromised ORDER BY
         md5(concat_ws('|', CAST(p.sigma AS STRING), p.mechanism, CAST(r.repeat AS STRING), p.session_id)), p.session_id)
         - 1) % 5 AS INTEGER) AS fold
FROM a_predictions p CROSS JOIN (SELECT unnest([1, 2, 3]) AS repeat) r WHERE p.mechanism <> 'rules'"""
CTES["o_configurations"] = f"""
SELECT mechanism AS model, CAST(sigma * 2 AS INTEGER) AS position, round_even(avg(f1), 4) AS mean_f1,
       round_even(stddev_pop(f1), 4) AS std_f1
FROM (SELECT mechanism, sigma, repeat, fold, coalesce({_F1}, 0) AS f1
      FROM (SELECT mechanism, sigma, repeat, fold, {_confusion()} FROM o_folds
            GROUP BY mechanism, sigma, repeat, fold))
GROUP BY mechanism, sigma"""

_NAMES = re.compile(r"\b([akog]_[a-z0-9_]+)\b")


def _needed(body: str, found: set[str]) -> set[str]:
    for name in _NAMES.findall(body):
        if name in CTES and name not in found:
            found.add(name)
            _needed(CTES[name], found)
    return found


def _snapped(sql: str) -> str:
    """Each rounding done on the scaled value after six more digits, so that a tie on paper is a tie here too."""
    call, out, place = "round_even(", "", 0
    while (start := sql.find(call, place)) >= 0:
        depth, comma, end = 1, -1, start + len(call)
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = _snapped(sql[start + len(call) : comma]), int(sql[comma + 1 : end - 1])
        out += f"{sql[place:start]}({call}round(({inner}) * 1E{digits}, {10 - digits}), 0) / 1E{digits})"
        place = end
    return out + sql[place:]


def statement(body: str) -> str:
    """The body under the CTEs it reaches, in the order they are defined."""
    wanted = _needed(body, set())
    chain = [f"{name} AS ({text})" for name, text in CTES.items() if name in wanted]
    return _snapped(("WITH " + ",\n".join(chain) + "\n" if chain else "") + body.strip())


IDS = f"session_id, operator_id, {OPENED}"
ATTR = ", ".join(ATTRIBUTES)
FLAGS = ", ".join(f"rule_{a}" for a in ATTRIBUTES)
_DECLARED = ", ".join(
    f"('{profile}', '{op}', {mix[op]!r}E0)" for profile, mix in DECLARED_MIX.items() for op in OPERATIONS
)


def _share_by(part: str, size: int, name: str) -> str:
    columns = ", ".join(
        f"coalesce((SELECT count(*) FROM o_traffic t WHERE t.regime = '{r}' AND {part} = g.x) / nullif(CAST((SELECT "
        f"count(*) FROM o_traffic t WHERE t.regime = '{r}') AS DOUBLE), 0), 0.0E0) AS {r}"
        for r in ("periodic_batch", "routine", "occasional_custody")
    )
    return f"SELECT g.x AS {name}, {columns} FROM (SELECT unnest(range(0, {size})) AS x) g"


_LOGFACT = "lgamma({0} + 1.0E0)"

BODIES: dict[str, str] = {
    "a2_runs_of_grid": """SELECT seed, sigma, mechanism, count(*) AS sessions, CAST(sum(predicted) AS BIGINT) AS alerts
        FROM a_predictions GROUP BY seed, sigma, mechanism""",
    "a4_runs_written_again": """SELECT seed, sigma, mechanism, count(*) AS sessions, CAST(sum(predicted) AS BIGINT) AS alerts,
        CAST(CASE WHEN seed = 3 AND sigma = 0.5 THEN 2 ELSE 1 END AS BIGINT) AS attempt
        FROM a_predictions GROUP BY seed, sigma, mechanism""",
    "a1_operators_both_layouts": """SELECT l.layout, o.operator_id, o.profile, o.regime, a.usual_ips, g.scopes
        FROM a_operators o
        JOIN (SELECT operator_id, string_agg(source_ip, '|' ORDER BY position) AS usual_ips FROM a_addresses GROUP BY 1) a
          ON o.operator_id = a.operator_id
        JOIN (SELECT operator_id, string_agg(scope, '|' ORDER BY scope) AS scopes FROM a_grants GROUP BY 1) g
          ON o.operator_id = g.operator_id
        CROSS JOIN (SELECT unnest(['csv', 'parquet']) AS layout) l""",
    "a2_one_run": "SELECT session_id, mechanism, predicted FROM a_predictions WHERE seed = 3 AND sigma = 0.5",
    "b4_columns": " UNION ALL ".join(
        f"SELECT '{phase}' AS phase, CAST({place} AS BIGINT) AS place, '{name}' AS \"column\", count(*) FILTER ({name} IS NULL) "
        f"AS empty FROM {source}"
        for phase, source, names in (
            ("warmup", "(SELECT * FROM o_sessions WHERE phase = 'warmup')", (*_IDENTIFIERS, *ATTRIBUTES)),
            ("evaluated", "o_eval", (*_IDENTIFIERS, *ATTRIBUTES, "compromised")),
        )
        for place, name in enumerate(names)
    ),
    "b5_guards": """SELECT 'operators_without_profile' AS guard, count(*) AS violations FROM o_eval e
          WHERE NOT EXISTS (SELECT 1 FROM o_profiles p WHERE p.seed = e.seed AND p.operator_id = e.operator_id)
        UNION ALL SELECT 'replicas_without_thresholds', count(*) FROM (SELECT DISTINCT seed FROM o_eval) e
          WHERE (SELECT count(*) FROM o_thresholds t WHERE t.seed = e.seed) <> 6
        UNION ALL SELECT 'wrong_thresholds', 6 - count(DISTINCT attribute) FROM o_thresholds
        UNION ALL SELECT 'unknown_operators', count(*) FROM a_requests r WHERE r.key_id IN (SELECT key_id FROM a_keys)
          AND NOT EXISTS (SELECT 1 FROM a_operators o WHERE o.seed = r.seed AND o.operator_id = r.operator_id)""",
    "c3_unknown_operators": """SELECT event_id, operator_id FROM a_requests WHERE key_id IN (SELECT key_id FROM a_keys)
        AND operator_id NOT IN (SELECT operator_id FROM a_operators WHERE profile = 'end_user')""",
    "c9_scopes_out_of_reach": """SELECT o.operator_id, s.scope, s.keys
        FROM a_operators o CROSS JOIN (SELECT scope, count(*) AS keys FROM a_keys GROUP BY scope) s
        WHERE NOT EXISTS (SELECT 1 FROM a_grants g WHERE g.operator_id = o.operator_id AND g.scope = s.scope)""",
    "e3_grid_holdout": "SELECT seed, sigma, compromised, session_id, position, side FROM g_split",
    "h1_cells_add_up": f"""SELECT seed, sigma, count(*) AS sessions, true_positives + false_positives + true_negatives
          + false_negatives AS in_cells FROM g_eval JOIN (SELECT seed, sigma, {_confusion()} FROM g_alerts GROUP BY seed, sigma)
        USING (seed, sigma) GROUP BY ALL""",
    "h3_grid_alerts": f"""SELECT seed, sigma, session_id, {OPENED}, {', '.join('rule_' + a for a in ATTRIBUTES)}, rules_fired,
        predicted, compromised FROM g_alerts""",
    "a5_runs_index": """SELECT r.seed, s.sigma, min(r.operator_id) AS compromised_admin
        FROM a_requests r JOIN a_labels b ON r.session_id = b.session_id
        CROSS JOIN (SELECT unnest([0.0E0, 0.5E0, 1.0E0]) AS sigma) s GROUP BY r.seed, s.sigma""",
    "a6_pooled_predictions": """SELECT mechanism, count(*) AS sessions, count(DISTINCT seed) AS seeds,
        CAST(sum(predicted) AS BIGINT) AS alerts FROM a_predictions WHERE sigma = 0.5 GROUP BY mechanism""",
    "a7_thresholds_of_seeds": "SELECT * FROM o_thresholds WHERE seed BETWEEN 1 AND 12",
    "a8_missing_runs": """SELECT g.seed, s.sigma FROM (SELECT unnest(range(1, 13)) AS seed) g
        CROSS JOIN (SELECT unnest([0.0E0, 0.25E0, 0.5E0, 0.75E0, 1.0E0]) AS sigma) s
        WHERE NOT EXISTS (SELECT 1 FROM a_predictions p WHERE p.seed = g.seed AND p.sigma = s.sigma)""",
    "b1_phase_counts": """SELECT seed,
        count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15') AS warmup,
        count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-29') AS evaluated,
        count(*) AS requests FROM a_requests GROUP BY seed""",
    "b2_week_bounds": """SELECT w.week, strftime(DATE '2024-01-01' + CAST((w.week - 1) * 7 AS INTEGER), '%Y-%m-%d')
        AS first_day, strftime(DATE '2024-01-01' + CAST(w.week * 7 AS INTEGER), '%Y-%m-%d') AS day_after_last,
        count(r.event_id) AS requests FROM (SELECT unnest(range(1, 5)) AS week) w
        LEFT JOIN a_requests r ON r.day_no // 7 + 1 = w.week GROUP BY w.week""",
    "b3_phase_slices": """SELECT phase AS slice, count(*) AS rows, count(DISTINCT key_id) AS keys
        FROM a_log WHERE phase IS NOT NULL GROUP BY phase""",
    "b6_administrators": """SELECT seed, operator_id, regime FROM a_operators WHERE profile = 'administrator'
        ORDER BY operator_id""",
    "b7_filter_expression": """SELECT count(*) FILTER (WHERE events > 4 AND failures_per_event > 0.2) AS kept,
        count(*) AS total, count(*) FILTER (WHERE events > 4 AND failures_per_event > 0.2) / CAST(count(*) AS DOUBLE)
        AS share FROM o_rated WHERE phase = 'warmup'""",
    "b8_of_condition": """SELECT seed, mechanism, sessions, positives, f1 FROM o_metrics
        WHERE sigma = 0.5 AND scope = 'all' AND mechanism IN ('model_a', 'model_b')""",
    "b9_business_days": """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS requests FROM a_requests
        WHERE isodow(ts) < 6 GROUP BY 1""",
    "b10_day_spine": """SELECT strftime(DATE '2024-01-01' + CAST(d.n AS INTEGER), '%Y-%m-%d') AS day,
        count(r.event_id) AS requests FROM (SELECT unnest(range(0, 28)) AS n) d
        LEFT JOIN a_requests r ON r.day_no = d.n GROUP BY d.n""",
    "b11_slice_shares": """SELECT seed, side, count(*) AS sessions, CAST(sum(compromised) AS BIGINT) AS positives,
        CAST(sum(compromised) AS DOUBLE) / count(*) AS positive_share FROM o_split GROUP BY seed, side""",
    "c1_audit_log": f"""SELECT event_id, session_id, operator_id, {_ISO.format('ts')} AS timestamp, source_ip, operation,
        key_id, outcome FROM a_log WHERE phase = 'evaluated'""",
    "c2_outcomes": "SELECT event_id, outcome FROM a_log",
    "c4_history_attributes": "SELECT session_id, operator_id, atypical_hour, new_source_ip FROM o_eval",
    "c5_labels": "SELECT session_id, compromised FROM a_scored",
    "c6_duplicates": f"""SELECT h.seed, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM o_split t WHERE t.seed = h.seed
        AND t.side = 'train' AND t.session_id = h.session_id) THEN h.session_id END) AS shared_sessions,
        count(*) FILTER (WHERE EXISTS (SELECT 1 FROM o_split t WHERE t.seed = h.seed AND t.side = 'train' AND
        {' AND '.join(f't.{a} IS NOT DISTINCT FROM h.{a}' for a in ATTRIBUTES)})) AS repeated_sessions
        FROM o_split h WHERE h.side = 'holdout' GROUP BY h.seed""",
    "c7_same_sessions": """SELECT coalesce(a.seed, b.seed) AS seed, coalesce(a.sigma, b.sigma) AS sigma,
        count(*) FILTER (WHERE b.session_id IS NULL) AS only_first,
        count(*) FILTER (WHERE a.session_id IS NULL) AS only_second
        FROM (SELECT * FROM a_predictions WHERE mechanism = 'rules') a
        FULL JOIN (SELECT * FROM a_predictions WHERE mechanism = 'model_a') b
        ON a.seed = b.seed AND a.sigma = b.sigma AND a.session_id = b.session_id GROUP BY 1, 2""",
    "c8_cutoffs": "SELECT * FROM o_cutoffs",
    "c9_reach": """SELECT o.operator_id, count(g.scope) AS in_reach, count(*) - count(g.scope) AS out_of_reach
        FROM a_operators o CROSS JOIN a_keys k LEFT JOIN a_grants g
        ON g.operator_id = o.operator_id AND g.scope = k.scope GROUP BY o.operator_id""",
    "c9_keys_out_of_reach": """SELECT o.operator_id, k.key_id FROM a_operators o CROSS JOIN a_keys k
        WHERE NOT EXISTS (SELECT 1 FROM a_grants g WHERE g.operator_id = o.operator_id AND g.scope = k.scope)""",
    "c10_scope_holders": """SELECT scope, operator_id, count(*) OVER (PARTITION BY scope) AS holders FROM a_grants""",
    "c10_uncovered_scopes": """SELECT s.scope, count(*) FILTER (WHERE o.profile = 'administrator') AS administrators,
        count(*) FILTER (WHERE o.profile = 'automated_service') AS services,
        CAST(count(o.operator_id) = 0 AS INTEGER) AS uncovered FROM (SELECT DISTINCT scope FROM a_keys) s
        LEFT JOIN a_grants g ON g.scope = s.scope LEFT JOIN a_operators o ON o.operator_id = g.operator_id
        GROUP BY s.scope""",
    "c11_operator_attributes": """SELECT session_id, operator_id, regime, source_ip,
        CAST(from_primary AS INTEGER) AS from_primary FROM o_traffic""",
    "d1_per_session": f"""SELECT seed, phase, session_id, operator_id, source_ip, {OPENED},
        {_ISO.format('closed_at')} AS closed_at, events, distinct_keys, failures, denials FROM o_base""",
    "d2_rate_attributes": """SELECT session_id, duration_minutes, requests_per_minute, failures_per_event,
        denials_per_event FROM o_whole_rated""",
    "d3_sessions": f"SELECT seed, {IDS}, {ATTR}, compromised FROM o_eval",
    "d3_warmup_sessions": f"SELECT seed, {IDS}, {ATTR} FROM o_sessions WHERE phase = 'warmup'",
    "d4_session_openings": f"SELECT seed, session_id, operator_id, source_ip, {OPENED} FROM o_whole",
    "d5_profiles": "SELECT * FROM o_profiles",
    "d6_window_width": """SELECT operator_id, round_even((epoch(CAST(window_closes_at AS TIME))
        - epoch(CAST(window_opens_at AS TIME))) / 3600.0E0, 6) AS width_hours FROM o_profiles""",
    "d7_thresholds": "SELECT * FROM o_thresholds",
    "d8_confusion": f"SELECT seed, sigma, mechanism, {_confusion()} FROM a_predictions GROUP BY seed, sigma, mechanism",
    "d9_rates": f"""SELECT seed, sigma, mechanism, {_RATES} FROM (SELECT seed, sigma, mechanism, {_confusion()}
        FROM a_predictions GROUP BY seed, sigma, mechanism)""",
    "d10_roc_points": """SELECT sigma, mechanism,
        count(*) FILTER (WHERE compromised = 0 AND predicted = 1)
          / nullif(CAST(count(*) FILTER (WHERE compromised = 0) AS DOUBLE), 0) AS false_positive_rate,
        count(*) FILTER (WHERE compromised = 1 AND predicted = 1)
          / nullif(CAST(count(*) FILTER (WHERE compromised = 1) AS DOUBLE), 0) AS true_positive_rate
        FROM a_predictions GROUP BY sigma, mechanism""",
    "d11_roc_auc": _auc("a_predictions", "seed, sigma, mechanism"),
    "d12_negatives_per_positive": """SELECT seed, count(*) FILTER (WHERE compromised = 0)
        / nullif(CAST(sum(compromised) AS DOUBLE), 0) AS negatives_per_positive FROM a_scored GROUP BY seed""",
    "d13_metrics": "SELECT * FROM o_metrics",
    "d14_partition_counts": """SELECT seed, count(*) FILTER (WHERE side = 'train') AS train_sessions,
        count(*) FILTER (WHERE side = 'train' AND compromised = 1) AS train_positives,
        count(*) FILTER (WHERE side = 'holdout') AS holdout_sessions,
        count(*) FILTER (WHERE side = 'holdout' AND compromised = 1) AS holdout_positives
        FROM o_split GROUP BY seed""",
    "d15_triviality": f"""SELECT c.*, s.stump_attribute, s.stump_threshold, s.stump_f1, 0::BIGINT AS shared_sessions,
        r.repeated_sessions FROM (SELECT seed, count(*) FILTER (WHERE side = 'train') AS train_sessions,
        count(*) FILTER (WHERE side = 'train' AND compromised = 1) AS train_positives,
        count(*) FILTER (WHERE side = 'holdout') AS holdout_sessions,
        count(*) FILTER (WHERE side = 'holdout' AND compromised = 1) AS holdout_positives
        FROM o_split GROUP BY seed) c JOIN o_stump s ON c.seed = s.seed JOIN (
        SELECT seed, count(*) FILTER (WHERE side = 'holdout' AND known) AS repeated_sessions FROM (
        SELECT seed, side, bool_or(side = 'train') OVER (PARTITION BY seed, {ATTR}) AS known FROM o_split)
        GROUP BY seed) r ON c.seed = r.seed""",
    "d16_median_f1": "SELECT * FROM o_median_f1",
    "d17_f1_summary": """SELECT scope, sigma, mechanism, round_even(quantile_cont(f1, 0.5), 6) AS median,
        round_even(quantile_cont(f1, 0.25), 6) AS q1, round_even(quantile_cont(f1, 0.75), 6) AS q3
        FROM o_metrics GROUP BY scope, sigma, mechanism""",
    "d18_timing_summary": """SELECT mechanism, count(*) AS runs,
        round_even(quantile_cont(microseconds_per_session, 0.5), 4) AS median_microseconds,
        round_even(quantile_cont(microseconds_per_session, 0.25), 4) AS q1_microseconds,
        round_even(quantile_cont(microseconds_per_session, 0.75), 4) AS q3_microseconds,
        round_even(quantile_cont(sessions_per_second, 0.5), 1) AS median_sessions_per_second
        FROM a_timings GROUP BY mechanism""",
    "d19_confusion_cells": """SELECT sigma, scope, mechanism, truth, decision, cases,
        cases / nullif(CAST(sum(cases) OVER (PARTITION BY sigma, scope, mechanism, truth) AS DOUBLE), 0)
        AS share_of_truth FROM (SELECT sigma, scope, mechanism,
        CASE WHEN compromised = 1 THEN 'attack' ELSE 'legitimate' END AS truth,
        CASE d.said WHEN 1 THEN 'alert' ELSE 'no alert' END AS decision,
        count(*) FILTER (WHERE predicted = d.said) AS cases
        FROM o_scoped CROSS JOIN (SELECT unnest([0, 1]) AS said) d GROUP BY sigma, scope, mechanism, compromised, d.said)""",
    "d19_grid_totals": """SELECT sigma, scope, count(DISTINCT seed) AS seeds, CAST(sum(compromised) AS BIGINT) AS attacks,
        CAST(sum(1 - compromised) AS BIGINT) AS legitimate FROM o_scoped WHERE mechanism = 'rules'
        GROUP BY sigma, scope""",
    "d20_confusion_report": "FROM (SELECT seed, "
    + ", ".join(
        f"CAST({name} AS DOUBLE) AS {name}"
        for name in ("true_positives", "false_positives", "true_negatives", "false_negatives")
    )
    + ", "
    + ", ".join(f"round_even({text}, 6) AS {name}" for name, text in _ALL_RATES.items())
    + f" FROM (SELECT seed, {_confusion()} FROM o_alerts GROUP BY seed)) UNPIVOT INCLUDE NULLS (value FOR measure IN (true_positives, false_positives, true_negatives, "
    "false_negatives, f1, precision, recall, accuracy, specificity))",
    "d21_rules_fired": """SELECT g.seed, g.compromised, g.rules_fired, count(a.session_id) / CAST(max(g.total) AS DOUBLE)
        AS share FROM (SELECT seed, compromised, total, unnest(range(0, 9)) AS rules_fired FROM (SELECT seed, compromised,
        count(*) AS total FROM o_alerts GROUP BY seed, compromised)) g LEFT JOIN o_alerts a ON a.seed = g.seed
        AND a.compromised = g.compromised AND a.rules_fired = g.rules_fired GROUP BY g.seed, g.compromised,
        g.rules_fired""",
    "d22_firing_rates": "SELECT seed, rule, legitimate, attack, CAST(row_number() OVER (PARTITION BY seed ORDER BY attack "
    "DESC NULLS LAST, place) = 1 AS INTEGER) AS is_most_fired FROM ("
    + " UNION ALL ".join(
        f"SELECT seed, {i} AS place, '{a}' AS rule, CAST(sum(rule_{a}) FILTER (WHERE compromised = 0) AS DOUBLE) "
        f"/ nullif(count(*) FILTER (WHERE compromised = 0), 0) AS legitimate, "
        f"CAST(sum(rule_{a}) FILTER (WHERE compromised = 1) AS DOUBLE) "
        f"/ nullif(count(*) FILTER (WHERE compromised = 1), 0) AS attack FROM o_alerts GROUP BY seed"
        for i, a in enumerate(ATTRIBUTES)
    )
    + ")",
    "d23_cutoff_curve": """SELECT a.seed, c.cutoff,
        count(*) FILTER (WHERE compromised = 0 AND rules_fired >= c.cutoff)
          / nullif(CAST(count(*) FILTER (WHERE compromised = 0) AS DOUBLE), 0) AS false_alarm,
        count(*) FILTER (WHERE compromised = 1 AND rules_fired >= c.cutoff)
          / nullif(CAST(count(*) FILTER (WHERE compromised = 1) AS DOUBLE), 0) AS recall
        FROM o_alerts a CROSS JOIN (SELECT unnest(range(1, 9)) AS cutoff) c GROUP BY a.seed, c.cutoff""",
    "d24_rules_over_sigma": """SELECT sigma, round_even(quantile_cont(f1, 0.5), 6) AS median_f1,
        round_even(quantile_cont(recall, 0.5), 6) AS median_recall,
        round_even(quantile_cont(specificity, 0.5), 6) AS median_specificity, count(DISTINCT seed) AS seeds
        FROM o_metrics WHERE mechanism = 'rules' AND scope = 'all' GROUP BY sigma""",
    "d25_threshold_spread": """SELECT attribute, count(*) AS seeds, round_even(quantile_cont(threshold, 0.5), 4) AS median,
        min(threshold) AS least, max(threshold) AS greatest,
        round_even(stddev_samp(threshold) / nullif(avg(threshold), 0), 6) AS variation
        FROM o_thresholds GROUP BY attribute""",
    "d26_threshold_histogram": """SELECT s.seed, s.attribute, s.bin, round_even(s.start + (s.bin + 0.5E0) * s.width, 4)
        AS centre, coalesce(sum(v.n) FILTER (WHERE v.value <= s.threshold), 0) / CAST(max(s.total) AS DOUBLE)
        AS up_to_threshold, coalesce(sum(v.n) FILTER (WHERE v.value > s.threshold), 0) / CAST(max(s.total) AS DOUBLE)
        AS above_threshold FROM (
          SELECT *, unnest(range(0, bins)) AS bin FROM (
            SELECT l.seed, l.attribute, t.threshold, l.total,
              CASE WHEN u THEN CAST(hi - lo AS BIGINT) + 1 ELSE 30 END AS bins,
              CASE WHEN u THEN 1.0E0 ELSE (hi - lo) / 30 END AS width, CASE WHEN u THEN lo - 0.5E0 ELSE lo END AS start
            FROM (SELECT seed, attribute, min(value) AS lo, max(value) AS hi, count(*) AS total,
                    attribute IN ('events', 'distinct_keys') OR min(value) = max(value) AS u
                  FROM o_warm_long WHERE phase = 'warmup' GROUP BY seed, attribute) l
            JOIN o_thresholds t ON l.seed = t.seed AND l.attribute = t.attribute)) s
        LEFT JOIN (SELECT seed, attribute, value, count(*) AS n FROM o_warm_long WHERE phase = 'warmup'
                   GROUP BY seed, attribute, value) v
          ON v.seed = s.seed AND v.attribute = s.attribute
          AND least(CAST(floor((v.value - s.start) / s.width) AS BIGINT), s.bins - 1) = s.bin
        GROUP BY s.seed, s.attribute, s.bin, s.start, s.width""",
    "d26_share_above_threshold": """SELECT w.seed, w.attribute, count(*) FILTER (WHERE w.value > t.threshold)
        / CAST(count(*) AS DOUBLE) AS above_threshold FROM o_warm_long w JOIN o_thresholds t ON w.seed = t.seed
        AND w.attribute = t.attribute WHERE w.phase = 'warmup' GROUP BY w.seed, w.attribute""",
    "d27_traffic_sessions": f"""SELECT session_id, operator_id, regime, {OPENED}, {_ISO.format('closed_at')} AS closed_at,
        events, round_even(minutes, 6) AS minutes, source_ip, CAST(from_primary AS INTEGER) AS from_primary
        FROM o_traffic""",
    "d28_business_day_counts": """SELECT operator_id, regime, strftime(day, '%Y-%m-%d') AS day, sessions FROM o_daily""",
    "d29_shares_on_axis": """SELECT t.regime, e.events, count(*) FILTER (WHERE t.events = e.events)
        / CAST(count(*) AS DOUBLE) AS share FROM o_traffic t CROSS JOIN (SELECT unnest(range(1, 6)) AS events) e
        GROUP BY t.regime, e.events""",
    "d30_hour_share": _share_by("hour(t.opened_at)", 24, "hour"),
    "d30_weekday_share": _share_by("isodow(t.opened_at) - 1", 7, "weekday"),
    "d31_session_sizes": "SELECT * FROM o_size_share",
    "d31_sessions_per_day": "SELECT * FROM o_day_share",
    "d32_operation_mix": f"""SELECT profile, operation, declared, round_even(m, 6) AS measured,
        round_even(max(abs(m - declared)) OVER (PARTITION BY profile), 6) AS largest_gap FROM (
        SELECT d.profile, d.operation, d.declared, count(r.event_id) FILTER (WHERE r.operation = d.operation)
          / CAST(count(*) AS DOUBLE) AS m
        FROM (VALUES {_DECLARED}) d(profile, operation, declared) JOIN a_operators o ON o.profile = d.profile
        JOIN a_requests r ON r.operator_id = o.operator_id GROUP BY d.profile, d.operation, d.declared)""",
    "d33_regime_overview": """SELECT o.regime, o.profile, o.operators, t.sessions, round_even(t.m, 6) AS median_minutes
        FROM (SELECT regime, min(profile) AS profile, count(*) AS operators FROM a_operators GROUP BY regime) o
        JOIN (SELECT regime, count(*) AS sessions, quantile_cont(minutes, 0.5) AS m FROM o_traffic GROUP BY regime) t
        ON o.regime = t.regime""",
    "d34_median_sessions": """SELECT regime, count(*) AS operators, quantile_cont(CAST(n AS DOUBLE), 0.5)
        AS median_sessions FROM (SELECT regime, operator_id, count(*) AS n FROM o_traffic
        WHERE opened_at >= TIMESTAMP '2024-01-15' AND opened_at < TIMESTAMP '2024-01-29' GROUP BY regime, operator_id)
        GROUP BY regime""",
    "d35_dispersion_index": """SELECT regime, count(*) AS operator_days, round_even(var_samp(n) / avg(n), 6) AS dispersion
        FROM (SELECT regime, operator_id, CAST(opened_at AS DATE) AS day, count(*) AS n FROM o_traffic
        GROUP BY regime, operator_id, 3) GROUP BY regime""",
    "d36_keys_per_scope": """SELECT scope, count(*) AS keys, (SELECT count(*) FROM a_keys)
        / CAST((SELECT count(DISTINCT scope) FROM a_keys) AS DOUBLE) AS even_share FROM a_keys GROUP BY scope
        ORDER BY keys DESC, scope""",
    "d37_importance_medians": "SELECT attribute, round_even(quantile_cont(f1_drop, 0.5), 6) AS rules, CASE attribute "
    + " ".join(f"WHEN '{a}' THEN {i + 1}::BIGINT" for i, a in enumerate(ATTRIBUTES))
    + " END AS place FROM o_importance GROUP BY attribute",
    "d38_session_invariants": """SELECT 'wrong_opening' AS "check", count(*) AS violations FROM o_eval e WHERE e.opened_at <>
          (SELECT min(ts) FROM a_log l WHERE l.session_id = e.session_id AND l.phase = 'evaluated')
        UNION ALL SELECT 'failure_share', count(*) FROM o_eval WHERE failures_per_event NOT BETWEEN 0 AND 1
        UNION ALL SELECT 'more_denials_than_failures', count(*) FROM o_eval WHERE denials_per_event > failures_per_event
        UNION ALL SELECT 'more_keys_than_events', count(*) FROM o_eval WHERE distinct_keys > events
        UNION ALL SELECT 'bad_pace', count(*) FROM o_eval WHERE requests_per_minute IS NULL OR requests_per_minute < 0
        UNION ALL SELECT 'several_operators', count(*) FROM (SELECT session_id FROM a_log WHERE phase = 'evaluated'
          GROUP BY session_id HAVING count(DISTINCT operator_id) > 1)
        UNION ALL SELECT 'several_sources', count(*) FROM (SELECT session_id FROM a_log WHERE phase = 'evaluated'
          GROUP BY session_id HAVING count(DISTINCT source_ip) > 1)""",
    "d39_alert_counts": "SELECT seed, CAST(sum(predicted) AS BIGINT) AS alerts FROM o_alerts GROUP BY seed",
    "d40_rule_catalogue": "SELECT s.seed, r.place, r.rule, r.kind, coalesce(t.threshold, 1.0E0) AS fires_at FROM (SELECT "
    "DISTINCT seed FROM o_thresholds) s CROSS JOIN (VALUES "
    + ", ".join(
        f"({i}::BIGINT, '{a}', '{'magnitude' if a in MAGNITUDE_ATTRIBUTES else 'history'}')"
        for i, a in enumerate(ATTRIBUTES)
    )
    + ") r(place, rule, kind) LEFT JOIN o_thresholds t ON t.seed = s.seed AND t.attribute = r.rule",
    "d41_class_sizes": """SELECT seed, count(*) AS sessions, count(*) FILTER (WHERE compromised = 0) AS legitimate,
        count(*) FILTER (WHERE compromised = 1) AS attack FROM o_split WHERE side = 'holdout' GROUP BY seed""",
    "d42_request_period": """SELECT 'silent_operators' AS "check", count(*) AS violations FROM a_operators o WHERE NOT EXISTS
          (SELECT 1 FROM a_requests r WHERE r.operator_id = o.operator_id)
        UNION ALL SELECT 'outside_period', count(*) FROM a_requests WHERE day_no >= 28
        UNION ALL SELECT 'foreign_sources', count(*) FROM a_requests r WHERE NOT EXISTS
          (SELECT 1 FROM a_addresses d WHERE d.operator_id = r.operator_id AND d.source_ip = r.source_ip)""",
    "e1_stable_order": "SELECT seed, compromised, session_id, position, tie FROM o_placed",
    "e2_holdout_sizes": """SELECT seed, compromised, count(*) AS sessions,
        CAST(floor(count(*) * 0.4E0 + 0.5E0) AS BIGINT) AS holdout FROM a_scored GROUP BY seed, compromised""",
    "e3_holdout": "SELECT seed, compromised, session_id, position, side FROM o_split",
    "e4_event_numbers": """SELECT seed, event_id, position, concat('event_', CASE WHEN position >= 1000000
        THEN CAST(position AS STRING) ELSE lpad(CAST(position AS STRING), 6, '0') END) AS event_number
        FROM o_events_placed""",
    "e5_session_numbers": """SELECT seed, session_id, concat('session_', lpad(CAST(row_number() OVER (PARTITION BY seed
        ORDER BY first_position) AS STRING), 5, '0')) AS session_number FROM (SELECT seed, session_id,
        min(position) AS first_position FROM o_events_placed GROUP BY seed, session_id)""",
    "e6_injected_sessions": """SELECT p.seed, concat('event_', lpad(CAST(p.position AS STRING), 6, '0')) AS event_number,
        concat('session_', lpad(CAST(dense_rank() OVER (PARTITION BY p.seed ORDER BY p.first_position) AS STRING), 5, '0'))
        AS session_number, p.event_id, CASE WHEN b.session_id IS NULL THEN 0 ELSE 1 END AS compromised
        FROM (SELECT *, min(position) OVER (PARTITION BY seed, session_id) AS first_position FROM (SELECT *,
          row_number() OVER (PARTITION BY seed ORDER BY ts, session_id, event_id) AS position FROM a_log
          WHERE phase = 'evaluated')) p LEFT JOIN a_labels b ON p.session_id = b.session_id""",
    "e7_chosen_configuration": """SELECT model, position, mean_f1, std_f1 FROM o_configurations
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean_f1 DESC, std_f1, position) = 1""",
    "a3_configuration": """SELECT model, 'sigma' AS parameter, CAST(position / 2 AS VARCHAR) AS value, 'real' AS kind,
        CAST(NULL AS BIGINT) AS integer_value, position / 2 AS real_value FROM o_configurations
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean_f1 DESC, std_f1, position) = 1""",
    "h9_grid_of_search": """SELECT mechanism AS model, CAST(sigma * 2 AS INTEGER) AS position,
        concat('sigma=', CAST(sigma AS VARCHAR)) AS parameters, count(DISTINCT (repeat, fold)) AS folds
        FROM o_folds GROUP BY ALL""",
    "e8_most_important": """SELECT 'rules' AS mechanism, CASE WHEN m < 0.01 THEN 'none' ELSE attribute END AS attribute,
        round_even(m, 6) AS median_drop FROM (SELECT attribute, quantile_cont(f1_drop, 0.5) AS m FROM o_importance
        GROUP BY attribute) QUALIFY row_number() OVER (ORDER BY m DESC, list_position(["""
    + ", ".join(f"'{a}'" for a in ATTRIBUTES)
    + "], attribute)) = 1",
    "e9_roc_curve": """SELECT sigma, mechanism, round_even(score, 9) AS score, false_positive_rate, true_positive_rate FROM (
        SELECT DISTINCT sigma, mechanism, score,
          count(*) FILTER (WHERE compromised = 0) OVER down / nullif(CAST(count(*) FILTER (WHERE compromised = 0)
            OVER (PARTITION BY sigma, mechanism) AS DOUBLE), 0) AS false_positive_rate,
          count(*) FILTER (WHERE compromised = 1) OVER down / nullif(CAST(count(*) FILTER (WHERE compromised = 1)
            OVER (PARTITION BY sigma, mechanism) AS DOUBLE), 0) AS true_positive_rate
        FROM a_predictions WHERE score IS NOT NULL
        WINDOW down AS (PARTITION BY sigma, mechanism ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        UNION ALL SELECT DISTINCT sigma, mechanism, NULL, 0.0E0, 0.0E0 FROM a_predictions WHERE score IS NOT NULL)""",
    "e10_stump": "SELECT * FROM o_stump",
    "e11_signed_rank": """SELECT sigma, model, pairs, CAST(statistic AS DOUBLE) AS statistic,
        round_even(p_value, 6) AS p_value FROM o_tested""",
    "e12_holm": """SELECT t.sigma, t.model, round_even(t.p_value, 6) AS p_value, round_even(h.p_holm, 6) AS p_holm
        FROM o_tested t LEFT JOIN (SELECT sigma, model, least(1.0E0, max(step) OVER (ORDER BY p, sigma, model
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm FROM (SELECT sigma, model, p, p * (count(*) OVER ()
          - row_number() OVER (ORDER BY p, sigma, model) + 1) AS step FROM (SELECT sigma, model, round_even(p_value, 6)
          AS p FROM o_tested WHERE p_value IS NOT NULL))) h ON t.sigma = h.sigma AND t.model = h.model""",
    "e13_sample_quotas": """SELECT seed, outcome, requests, CAST(f + CASE WHEN row_number() OVER (PARTITION BY seed
        ORDER BY e - f DESC, outcome) <= 100 - sum(f) OVER (PARTITION BY seed) THEN 1 ELSE 0 END AS BIGINT) AS quota
        FROM (SELECT *, floor(e) AS f FROM (SELECT seed, outcome, count(*) AS requests, count(*) * 100.0E0
          / sum(count(*)) OVER (PARTITION BY seed) AS e FROM a_log GROUP BY seed, outcome))""",
    "f1_sorted_operators": """SELECT seed, operator_id, row_number() OVER (PARTITION BY seed ORDER BY operator_id) AS place
        FROM a_operators""",
    "f2_top_mechanism": """SELECT sigma, scope, mechanism, median_f1 FROM o_median_f1
        QUALIFY row_number() OVER (PARTITION BY sigma, scope ORDER BY median_f1 DESC NULLS LAST, mechanism) = 1""",
    "f3_shuffled_rows": """SELECT seed, session_id, row_number() OVER (PARTITION BY seed ORDER BY
        md5(concat_ws('|', CAST(seed AS STRING), session_id)), session_id) AS place FROM o_whole""",
    "f4_stacked_sides": """SELECT seed, side, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events
        FROM o_split GROUP BY seed, side""",
    "f5_operators_of_both_phases": """SELECT operator_id FROM a_log WHERE phase = 'warmup'
        INTERSECT SELECT operator_id FROM a_log WHERE phase = 'evaluated'""",
    "f6_keys_not_evaluated": """SELECT operator_id, key_id FROM a_log WHERE phase = 'warmup'
        EXCEPT SELECT operator_id, key_id FROM a_log WHERE phase = 'evaluated'""",
    "f7_threshold_set": """SELECT count(*) FILTER (WHERE f.attribute IS NULL) AS missing,
        count(*) FILTER (WHERE e.attribute IS NULL) AS "foreign" FROM (SELECT unnest(["""
    + ", ".join(f"'{a}'" for a in MAGNITUDE_ATTRIBUTES)
    + """]) AS attribute) e FULL JOIN (SELECT DISTINCT attribute FROM o_thresholds) f ON e.attribute = f.attribute""",
    "f8_novel_addresses": """SELECT DISTINCT source_ip FROM a_log WHERE phase = 'evaluated' AND source_ip NOT IN
        (SELECT source_ip FROM a_log WHERE phase = 'warmup')""",
    "f8_foreign_addresses": """SELECT (SELECT count(DISTINCT source_ip) FROM a_addresses) AS known_addresses,
        (SELECT count(DISTINCT source_ip) FROM a_requests WHERE source_ip NOT IN (SELECT source_ip FROM a_addresses))
        AS foreign_addresses""",
    "g1_multivalue_cells": """SELECT operator_id, string_agg(DISTINCT source_ip, '|' ORDER BY source_ip) AS cell
        FROM a_addresses GROUP BY operator_id""",
    "g2_clock_and_iso": f"""SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, {_ISO.format('ts')} AS iso
        FROM a_requests""",
    "g3_identifiers": """SELECT event_id, printf('event_%06d', event_id) AS wide, printf('event_%02d', event_id) AS narrow
        FROM k_events""",
    "g4_daily_counts_expected": f"""SELECT regime, sessions, round_even(share, 6) AS observed,
        round_even(p, 6) AS poisson, round_even(b, 6) AS negative_binomial,
        round_even(max(abs(share - p)) OVER (PARTITION BY regime), 6) AS largest_gap FROM (
        SELECT s.regime, s.sessions, s.share, exp(s.sessions * ln(m.mean) - m.mean - {_LOGFACT.format('s.sessions')}) AS p,
          (s.sessions + 1) * pow(2 / (2 + m.mean), 2) * pow(m.mean / (2 + m.mean), s.sessions) AS b
        FROM o_day_share s JOIN (SELECT regime, avg(sessions) AS mean FROM o_daily GROUP BY regime) m
        ON s.regime = m.regime)""",
    "g4_session_sizes_expected": """SELECT regime, events, round_even(share, 6) AS observed, round_even(g, 6) AS geometric,
        round_even(max(abs(share - g)) OVER (PARTITION BY regime), 6) AS largest_gap FROM (
        SELECT s.regime, s.events, s.share, pow(1 - 1 / m.mean, s.events - 1) / m.mean AS g FROM o_size_share s
        JOIN (SELECT regime, avg(events) AS mean FROM o_traffic GROUP BY regime) m ON s.regime = m.regime)""",
    "g4_gaps_expected": """WITH gaps AS (SELECT regime, us FROM (SELECT o.regime, epoch_us(r.ts) - epoch_us(lag(r.ts)
          OVER (PARTITION BY r.session_id ORDER BY r.ts, r.event_id)) AS us FROM a_requests r JOIN a_operators o
          ON r.operator_id = o.operator_id) WHERE us IS NOT NULL),
        means AS (SELECT regime, CAST(sum(us) AS DOUBLE) / count(*) / 1E6 AS mean, count(*) AS total FROM gaps
          GROUP BY regime),
        sized AS (SELECT m.*, (SELECT arg_min(w, (abs(w - 4.0E0 * m.mean / 20), w)) FROM
          (SELECT unnest([1, 2, 5, 10, 20, 30, 60]) AS w UNION ALL
          SELECT CAST(60 * s * pow(10, k) AS BIGINT) FROM (SELECT unnest([2, 5, 10]) AS s), (SELECT unnest(range(0, 9)) AS k))) AS width FROM means m),
        bars AS (SELECT regime, mean, total, width, unnest(range(0, CAST(ceil(4.0E0 * mean / width) AS BIGINT))) * width
          AS from_second FROM sized),
        counted AS (SELECT g.regime, CAST(floor(g.us / 1E6 / s.width) * s.width AS BIGINT) AS from_second, count(*) AS n
          FROM gaps g JOIN sized s ON g.regime = s.regime GROUP BY 1, 2)
        SELECT regime, from_second, CAST(width AS BIGINT) AS width, round_even(o, 6) AS observed,
          round_even(e, 6) AS exponential, round_even(max(abs(o - e)) OVER (PARTITION BY regime), 6) AS largest_gap
        FROM (SELECT b.regime, b.from_second, b.width, coalesce(c.n, 0) / CAST(b.total AS DOUBLE) AS o,
          exp(-b.from_second / b.mean) - exp(-(b.from_second + b.width) / b.mean) AS e FROM bars b
          LEFT JOIN counted c ON b.regime = c.regime AND b.from_second = c.from_second)""",
    "g5_address_usage": """SELECT regime, position, sessions, round_even(sessions / CAST(sum(sessions)
        OVER (PARTITION BY regime) AS DOUBLE), 6) AS observed, round_even(0.8E0 * pow(0.2E0, position - 1)
        / (1 - pow(0.2E0, 4)), 6) AS expected FROM (SELECT t.regime, CAST(d.position AS BIGINT) AS position,
        count(*) AS sessions FROM o_traffic t JOIN a_addresses d ON t.operator_id = d.operator_id
        AND t.source_ip = d.source_ip GROUP BY t.regime, d.position)""",
    "g5_unseen_addresses": """SELECT CAST(d.position AS BIGINT) AS position, count(*) AS operators,
        round_even(count(*) FILTER (WHERE NOT list_contains(string_split(p.observed_ips, '|'), d.source_ip))
          / CAST(count(*) AS DOUBLE), 6) AS never_seen,
        round_even(avg(pow(1 - 0.8E0 * pow(0.2E0, d.position - 1) / (1 - pow(0.2E0, 4)), p.session_count)), 6)
        AS expected_never_seen FROM a_addresses d JOIN o_profiles p ON d.operator_id = p.operator_id
        GROUP BY d.position""",
    "g6_verdicts": """SELECT sigma, model, CASE WHEN excluded THEN 'excluded' WHEN significant THEN 'significant'
        ELSE 'not significant' END AS verdict FROM o_comparison""",
    "h1_fired_rules": f"SELECT session_id, {FLAGS} FROM o_alerts",
    "h2_decisions": "SELECT session_id, rules_fired, predicted FROM o_alerts",
    "h3_rule_alerts": f"SELECT seed, {IDS}, {FLAGS}, rules_fired, predicted, compromised FROM o_alerts",
    "h3_holdout_alerts": f"""SELECT seed, {IDS}, {FLAGS}, rules_fired, predicted, compromised FROM o_split
        WHERE side = 'holdout'""",
    "h6_class_weights": """SELECT seed, round_even(n / nullif(2.0E0 * p, 0), 6) AS forest_positive,
        round_even(n / nullif(2.0E0 * (n - p), 0), 6) AS forest_negative,
        round_even((n - p) / nullif(CAST(p AS DOUBLE), 0), 6) AS boosting_positive FROM (SELECT seed, count(*) AS n,
        sum(compromised) AS p FROM o_split WHERE side = 'train' GROUP BY seed)""",
    "h7_folds": """SELECT s.seed, s.compromised, s.session_id, r.repeat, CAST((row_number() OVER (PARTITION BY s.seed,
        r.repeat, s.compromised ORDER BY md5(concat_ws('|', CAST(s.seed AS STRING), CAST(r.repeat AS STRING),
        s.session_id)), s.session_id) - 1) % 5 AS INTEGER) AS fold FROM o_split s
        CROSS JOIN (SELECT unnest([1, 2, 3]) AS repeat) r WHERE s.side = 'train'""",
    "h8_fold_aggregate": "SELECT model, position, mean_f1, std_f1 FROM o_configurations",
    "h11_permutations": """SELECT seed, attribute, CAST(repeat AS INTEGER) AS repeat, to_place AS position,
        from_place AS from_position FROM o_orders""",
    "h12_rule_importance": "SELECT * FROM o_importance",
    "h13_paired_differences": """SELECT seed, sigma, model, round_even(difference, 6) AS difference FROM o_differences""",
    "h14_comparison": """SELECT sigma, model, seeds, median_f1_model, median_f1_rules, median_difference, q1_difference,
        q3_difference, CAST(statistic AS DOUBLE) AS statistic, p_value, stump_median_f1,
        CAST(excluded AS INTEGER) AS excluded, p_holm, CAST(significant AS INTEGER) AS significant,
        median_f1_model_administrators, median_f1_rules_administrators FROM o_comparison""",
    "h15_evaluation": """SELECT 'metrics' AS result, count(*) AS rows, CAST(sum(true_positives) AS BIGINT) AS total
        FROM o_metrics
        UNION ALL SELECT 'triviality', 3 * (SELECT count(DISTINCT seed) FROM o_split), 3 * count(*) FROM o_split
          WHERE side = 'holdout'
        UNION ALL SELECT 'comparison', count(*), CAST(sum(seeds) AS BIGINT) FROM o_comparison
        UNION ALL SELECT 'timing', (SELECT count(DISTINCT mechanism) FROM a_timings), count(*) FROM a_timings""",
    "s1_streaming_outcomes": "SELECT event_id, outcome FROM a_log",
    "s1_redelivered_outcomes": "SELECT event_id, outcome FROM a_log",
    "s2_streaming_sessions": f"SELECT seed, {IDS}, {', '.join(MAGNITUDE_ATTRIBUTES)} FROM o_whole_rated",
    "s2_redelivered_sessions": f"SELECT seed, {IDS}, {', '.join(MAGNITUDE_ATTRIBUTES)} FROM o_whole_rated",
    "s3_streaming_alerts": f"SELECT seed, {IDS}, {FLAGS}, rules_fired, predicted FROM o_whole_alerts",
}

# A body that opens its own WITH becomes a subquery under the shared CTEs.
ORACLES: dict[str, str] = {
    name: statement(f"SELECT * FROM ({body})" if body.lstrip().startswith(("WITH", "FROM")) else body)
    for name, body in BODIES.items()
}
