"""Names and explicit schemas of every table. Nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

# Outcomes of a request, in order of precedence after "success".
SUCCESS = "success"
DENIED_BY_POLICY = "denied_by_policy"
DISABLED_KEY = "disabled_key"
UNKNOWN_KEY = "unknown_key"
OUTCOMES = (SUCCESS, DENIED_BY_POLICY, DISABLED_KEY, UNKNOWN_KEY)

# The session table.
IDENTIFIERS = ("session_id", "operator_id", "opened_at")
ATTRIBUTES = (
    "events",
    "duration_minutes",
    "requests_per_minute",
    "distinct_keys",
    "failures_per_event",
    "denials_per_event",
    "atypical_hour",
    "new_source_ip",
)
MAGNITUDE_ATTRIBUTES = ATTRIBUTES[:6]
HISTORY_ATTRIBUTES = ATTRIBUTES[6:]
LABEL = "compromised"

# Calibration and the rule baseline.
THRESHOLD_PERCENTILE = 99
HISTORY_RULE_FIRES_AT = 1
MINIMUM_RULES_FIRED = 2
RULE_COLUMNS = tuple(f"rule_{name}" for name in ATTRIBUTES)

# Split, search, importance, statistics.
HOLDOUT_SHARE = 0.4
CROSS_VALIDATION_FOLDS = 5
CROSS_VALIDATION_REPEATS = 3
PERMUTATION_REPEATS = 10
STUMP_MEDIAN_F1_CUTOFF = 0.95
SIGNIFICANCE_LEVEL = 0.05
MINIMUM_READABLE_DROP = 0.01

# Populations.
ADMINISTRATOR = "administrator"
RULES = "rules"
ALL_SESSIONS = "all"
ADMINISTRATORS = "administrators"
SCOPES = (ALL_SESSIONS, ADMINISTRATORS)
REGIMES = ("periodic_batch", "routine", "occasional_custody")
OPERATIONS = ("Decrypt", "Encrypt", "DescribeKey", "ExportKeyMaterial")

# Declared operation mix per profile.
DECLARED_MIX = {
    "end_user": {"Decrypt": 0.55, "Encrypt": 0.25, "DescribeKey": 0.12, "ExportKeyMaterial": 0.08},
    "automated_service": {"Decrypt": 0.45, "Encrypt": 0.35, "DescribeKey": 0.10, "ExportKeyMaterial": 0.10},
    "administrator": {"Decrypt": 0.35, "Encrypt": 0.15, "DescribeKey": 0.30, "ExportKeyMaterial": 0.20},
}

# Share of the first usual address, dispersion of the custody regime.
PRIMARY_ADDRESS_SHARE = 0.80
CUSTODY_DISPERSION = 2

MULTIVALUE_SEPARATOR = "|"


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _B = T.TimestampNTZType(), T.BooleanType()

OPERATORS = _struct(operator_id=_S, profile=_S, scopes=T.ArrayType(_S), regime=_S, usual_ips=T.ArrayType(_S))
KEYS = _struct(key_id=_S, scope=_S, status=_S)
REQUESTS = _struct(
    event_id=_S, session_id=_S, operator_id=_S, timestamp=_TS, source_ip=_S, operation=_S, key_id=_S
)
REQUEST_OUTCOMES = _struct(event_id=_S, outcome=_S)
LOG = T.StructType(REQUESTS.fields + [T.StructField("outcome", _S, True)])
PROFILES = _struct(
    operator_id=_S, window_opens_at=_S, window_closes_at=_S, observed_ips=T.ArrayType(_S), session_count=_L
)
COMPROMISED_SESSIONS = _struct(session_id=_S)
RUN = _struct(seed=_I, sigma=_D, compromised_admin=_S)
WARMUP_SESSIONS = _struct(
    session_id=_S,
    operator_id=_S,
    opened_at=_TS,
    events=_L,
    duration_minutes=_D,
    requests_per_minute=_D,
    distinct_keys=_L,
    failures_per_event=_D,
    denials_per_event=_D,
    atypical_hour=_I,
    new_source_ip=_I,
)
EVALUATED_SESSIONS = T.StructType(WARMUP_SESSIONS.fields + [T.StructField(LABEL, _I, True)])
THRESHOLDS = _struct(attribute=_S, threshold=_D, percentile=_I, sessions=_L)
RULE_PREDICTIONS = T.StructType(
    WARMUP_SESSIONS.fields[:3]
    + [T.StructField(name, _I, True) for name in RULE_COLUMNS + ("rules_fired", "predicted", LABEL)]
)
METRICS = _struct(
    seed=_I, sigma=_D, mechanism=_S, scope=_S, sessions=_L, positives=_L,
    true_positives=_L, false_positives=_L, true_negatives=_L, false_negatives=_L,
    f1=_D, precision=_D, recall=_D, accuracy=_D, specificity=_D, roc_auc=_D,
)
TRIVIALITY = _struct(
    seed=_I, sigma=_D, train_sessions=_L, train_positives=_L, holdout_sessions=_L, holdout_positives=_L,
    stump_attribute=_S, stump_threshold=_D, stump_f1=_D, shared_sessions=_L, repeated_sessions=_L,
)
COMPARISON = _struct(
    sigma=_D, model=_S, seeds=_L, median_f1_model=_D, median_f1_rules=_D, median_difference=_D,
    q1_difference=_D, q3_difference=_D, statistic=_D, p_value=_D, stump_median_f1=_D, excluded=_B,
    p_holm=_D, significant=_B, median_f1_model_administrators=_D, median_f1_rules_administrators=_D,
)
TIMINGS = _struct(
    mechanism=_S, sessions=_L, timed_rounds=_I, median_nanoseconds=_L, microseconds_per_session=_D,
    sessions_per_second=_D,
)
IMPORTANCE = _struct(seed=_I, sigma=_D, mechanism=_S, attribute=_S, f1_drop=_D)
SEARCH_RESULTS = _struct(model=_S, position=_I, parameters=_S, mean_f1=_D, std_f1=_D)
CONFIGURATION = _struct(model=_S, parameter=_S, value=_S)

# Multi-value cells are arrays in Spark and joined text in CSV files.
TABLES = {
    "operators": OPERATORS,
    "keys": KEYS,
    "requests": REQUESTS,
    "outcomes": REQUEST_OUTCOMES,
    "log": LOG,
    "historical_profiles": PROFILES,
    "compromised_sessions": COMPROMISED_SESSIONS,
    "run": RUN,
    "warmup_sessions": WARMUP_SESSIONS,
    "sessions": EVALUATED_SESSIONS,
    "thresholds": THRESHOLDS,
    "train": EVALUATED_SESSIONS,
    "holdout": EVALUATED_SESSIONS,
    "predictions_rules": RULE_PREDICTIONS,
    "metrics": METRICS,
    "triviality": TRIVIALITY,
    "comparison": COMPARISON,
    "timing": TIMINGS,
    "importance": IMPORTANCE,
    "search_results": SEARCH_RESULTS,
    "config": CONFIGURATION,
}
