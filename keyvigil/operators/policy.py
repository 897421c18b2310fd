"""Policy decision on each request, the audit log, and who reaches which key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyvigil.functions.calendar import Period
from keyvigil.schemas import ADMINISTRATOR, DENIED_BY_POLICY, DISABLED_KEY, SUCCESS, UNKNOWN_KEY


def grants_of(operators: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per (operator, scope held)."""
    return operators.select(*by, "operator_id", F.explode(F.array_distinct("scopes")).alias("scope"))


def phase_log(
    requests: DataFrame, keys: DataFrame, grants: DataFrame, period: Period, phase: str, by: Sequence[str] = (),
    key_by: Sequence[str] | None = None,
) -> DataFrame:
    """The audit log of a phase in one go: the phase is cut first, then decided, and nothing is joined by event."""
    return decided(requests.where(period.belongs_to(phase, F.col("timestamp"))), keys, grants, by, key_by)


def administrators_of(operators: DataFrame) -> DataFrame:
    return operators.where(F.col("profile") == ADMINISTRATOR)


def decision(status: Column, held: Column) -> Column:
    """First match wins. The operation asked for plays no part."""
    return (
        F.when(status.isNull(), UNKNOWN_KEY)
        .when(held.isNull(), DENIED_BY_POLICY)
        .when(status == "disabled", DISABLED_KEY)
        .otherwise(SUCCESS)
    )


def decided(
    requests: DataFrame,
    keys: DataFrame,
    grants: DataFrame,
    by: Sequence[str] = (),
    key_by: Sequence[str] | None = None,
) -> DataFrame:
    """Requests with their outcome: two lookups and a CASE, no row of the log is ever grouped.

    Operators belong to a replica (`by`); the repository may be one for all (`key_by` empty; it is `by` if not given).
    The second join is keyed on (operator, scope), so the rows of one very busy operator already spread over its
    scopes; a partition that is still too large is split by the adaptive skew join.
    """
    key_by = by if key_by is None else key_by
    repository = keys.select(*key_by, "key_id", F.col("scope").alias("_scope"), F.col("status").alias("_status"))
    held = grants.select(*by, "operator_id", F.col("scope").alias("_scope"), F.lit(1).alias("_held"))
    return (
        requests.join(repository, [*key_by, "key_id"], "left")
        .join(held, [*by, "operator_id", "_scope"], "left")
        .withColumn("outcome", decision(F.col("_status"), F.col("_held")))
        .drop("_scope", "_status", "_held")
    )


def outcomes(
    requests: DataFrame, keys: DataFrame, grants: DataFrame, by: Sequence[str] = (), key_by: Sequence[str] | None = None
) -> DataFrame:
    return decided(requests, keys, grants, by, key_by).select(*by, "event_id", "outcome")


def audit_log(
    requests: DataFrame, outcome_table: DataFrame, period: Period, phase: str, by: Sequence[str] = ()
) -> DataFrame:
    """Requests of a phase joined with outcomes that were stored apart; rows on one side only vanish."""
    of_phase = requests.where(period.belongs_to(phase, F.col("timestamp")))
    return of_phase.join(outcome_table.select(*by, "event_id", "outcome"), [*by, "event_id"], "inner")


def unknown_operators(
    requests: DataFrame, operators: DataFrame, keys: DataFrame, by: Sequence[str] = (), key_by: Sequence[str] | None = None
) -> DataFrame:
    """Requests for an existing key by an operator nobody registered."""
    key_by = by if key_by is None else key_by
    existing = requests.join(keys.select(*key_by, "key_id"), [*key_by, "key_id"], "left_semi")
    return existing.join(operators.select(*by, "operator_id"), [*by, "operator_id"], "left_anti")


def require_known_operators(
    requests: DataFrame, operators: DataFrame, keys: DataFrame, by: Sequence[str] = ()
) -> None:
    found = unknown_operators(requests, operators, keys, by).select("operator_id").take(1)
    if found:
        raise KeyError(f"operator {found[0][0]!r} asks for an existing key but is not registered")


def reach(grants: DataFrame, keys: DataFrame, by: Sequence[str] = (), key_by: Sequence[str] | None = None) -> DataFrame:
    """(operator, key) pairs an operator can use."""
    key_by = by if key_by is None else key_by
    listed = keys.select(*key_by, "key_id", "scope")
    return grants.join(listed, [*key_by, "scope"]).select(*by, "operator_id", "key_id")


def reach_counts(
    grants: DataFrame, keys: DataFrame, by: Sequence[str] = (), key_by: Sequence[str] | None = None
) -> DataFrame:
    """Keys in and out of reach per operator.

    Keys are counted per scope first, so the join carries one number per (operator, scope) instead of every pair of
    operator and key.
    """
    key_by = by if key_by is None else key_by
    per_scope = keys.groupBy(*key_by, "scope").agg(F.count("*").alias("_keys"))
    inside = (
        grants.join(per_scope, [*key_by, "scope"], "left")
        .groupBy(*by, "operator_id")
        .agg(F.coalesce(F.sum("_keys"), F.lit(0)).cast("bigint").alias("in_reach"))
    )
    if key_by:
        totals = keys.groupBy(*key_by).agg(F.count("*").alias("_all"))
        inside = inside.join(totals, list(key_by), "left")
    else:
        inside = inside.withColumn("_all", keys.agg(F.count("*")).scalar())
    return inside.withColumn("out_of_reach", F.col("_all") - F.col("in_reach")).drop("_all")


def scopes_out_of_reach(operators: DataFrame, keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(operator, scope) pairs that exist but are not held, with the number of keys in the scope.

    The scopes an operator lacks are an array difference on its own row; the list is as long as the repository has
    scopes. Keys stay counted: their pairs with operators would be a multiple of the repository.
    """
    per_scope = keys.groupBy("scope").agg(F.count("*").alias("keys"))
    every_scope = per_scope.agg(F.collect_list("scope")).scalar()
    missing = operators.select(
        *by, "operator_id", F.explode(F.array_except(every_scope, F.col("scopes"))).alias("scope")
    )
    return missing.join(per_scope, "scope").select(*by, "operator_id", "scope", "keys")


def out_of_reach(operators: DataFrame, keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(operator, key) pairs that exist but are not held, for where the keys themselves are asked for."""
    lacked = scopes_out_of_reach(operators, keys, by).drop("keys")
    return lacked.join(keys.select("key_id", "scope"), "scope").select(*by, "operator_id", "key_id")


def holders_by_scope(grants: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inverse index from each scope to the operators that hold it.

    It stays in long form with the size of each list beside it: a scope may be held by millions, so a list in one
    cell would put a whole group in one task.
    """
    sizes = grants.groupBy(*by, "scope").agg(F.count("*").alias("holders"))
    return grants.join(sizes, [*by, "scope"]).select(*by, "scope", "operator_id", "holders")


def scopes_without_holder(keys: DataFrame, grants: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    asked = keys.select(*by, "scope").distinct()
    return asked.join(grants.select(*by, "scope").distinct(), [*by, "scope"], "left_anti")


def keys_per_scope(keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys of each scope beside an even split."""
    counts = keys.groupBy(*by, "scope").agg(F.count("*").alias("keys"))
    if not by:
        return counts.withColumn("even_share", counts.agg(F.avg("keys")).scalar())
    return counts.join(counts.groupBy(*by).agg(F.avg("keys").alias("even_share")), list(by))


def novel_addresses(requests: DataFrame, operators: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Source addresses in the log that are nobody's usual address."""
    known = operators.select(*by, F.explode("usual_ips").alias("source_ip")).distinct()
    return requests.select(*by, "source_ip").distinct().join(known, [*by, "source_ip"], "left_anti")
