"""From the driver's `events` table to the domain tables. Replica = user id mod 10 + 1, session = two-day block."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyvigil.functions.calendar import EVALUATED, WARMUP, Period
from keyvigil.operators import policy
from keyvigil.operators.campaign import legitimate_of_evaluated
from keyvigil.schemas import ADMINISTRATOR
from keyvigil.session import configure, sized_for

PERIOD = Period(first_day=date(2024, 1, 1), warmup_weeks=2, evaluated_weeks=2)

# Fixed values of the adapter: key numbers below this exist, and they fall in this many scopes.
KEY_NUMBERS = 95
SCOPE_COUNT = 10
USUAL_ADDRESSES = 4
SIGMAS = (0.0, 0.5, 1.0)
STAND_INS = ("model_a", "model_b")


def _text(number: Column) -> Column:
    return number.cast("string")


def _scope(number: Column) -> Column:
    return F.concat(F.lit("scope_"), F.lpad(_text(number), 2, "0"))


class Adapter:
    """Lazy domain tables over one scale-factor folder. Each is built once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.period = PERIOD

    @cached_property
    def numbered_events(self) -> DataFrame:
        events = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        sized_for(self.spark, events)
        day_no = (F.dayofmonth("ts") - 1).cast("bigint")
        return events.select(
            "event_id",
            "ts",
            "user_id",
            "event_type",
            "value",
            F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
            day_no.alias("day_no"),
            F.floor(day_no / 2).cast("bigint").alias("block"),
        )

    @cached_property
    def keys(self) -> DataFrame:
        """At most KEY_NUMBERS rows: one per key number below the limit."""
        k = F.col("k")
        return (
            self.numbered_events.where(k < KEY_NUMBERS)
            .select("k")
            .distinct()
            .select(
                F.concat(F.lit("k_"), F.lpad(_text(k), 3, "0")).alias("key_id"),
                _scope(k % SCOPE_COUNT + 1).alias("scope"),
                F.when(k % 20 == 7, "disabled").otherwise("active").alias("status"),
            )
        )

    @cached_property
    def operators(self) -> DataFrame:
        """One row per user, grouped once; the scopes are an array difference on the row.

        A user holds every scope that exists but one, and an automated service lacks a second one.
        """
        user = F.col("user_id")
        kind = user % 11
        existing = self.keys.agg(F.collect_set("scope")).scalar()
        lacked = F.array(
            _scope(user % SCOPE_COUNT + 1),
            F.when(F.col("profile") == "automated_service", _scope((user + 3) % SCOPE_COUNT + 1)),
        )
        address = F.concat(
            F.lit("10."), _text(user % 256), F.lit("."), _text(F.floor(user / 256).cast("bigint")), F.lit(".")
        )
        return (
            self.numbered_events.select("user_id")
            .distinct()
            .select(
                "user_id",
                F.concat(F.lit("op_"), F.lpad(_text(user), 6, "0")).alias("operator_id"),
                (user % 10 + 1).cast("bigint").alias("seed"),
                F.when(kind.isin(0, 1), ADMINISTRATOR)
                .when(kind == 2, "automated_service")
                .otherwise("end_user")
                .alias("profile"),
                F.when(kind.isin(0, 1), "occasional_custody")
                .when(kind == 2, "periodic_batch")
                .otherwise("routine")
                .alias("regime"),
                F.array(*[F.concat(address, F.lit(str(n))) for n in range(1, USUAL_ADDRESSES + 1)]).alias("usual_ips"),
            )
            .withColumn("scopes", F.array_except(existing, lacked))
        )

    @cached_property
    def grants(self) -> DataFrame:
        return policy.grants_of(self.operators, ("seed",))

    @cached_property
    def administrators(self) -> DataFrame:
        return policy.administrators_of(self.operators)

    @cached_property
    def requests(self) -> DataFrame:
        user, block = F.col("user_id"), F.col("block")
        pick = (user * 31 + block * 17) % 10
        last = F.when(pick == 9, _text(3 + block % 2)).when(pick.isin(7, 8), "2").otherwise("1")
        return self.numbered_events.select(
            F.concat(F.lit("event_"), F.lpad(_text(F.col("event_id")), 9, "0")).alias("event_id"),
            F.concat(
                F.lit("s_"), F.lpad(_text(user), 6, "0"), F.lit("_"), F.lpad(_text(block), 2, "0")
            ).alias("session_id"),
            F.concat(F.lit("op_"), F.lpad(_text(user), 6, "0")).alias("operator_id"),
            F.col("ts").alias("timestamp"),
            F.concat(
                F.lit("10."), _text(user % 256), F.lit("."), _text(F.floor(user / 256).cast("bigint")), F.lit("."), last
            ).alias("source_ip"),
            F.when(F.col("event_type") == "purchase", "Encrypt")
            .when(F.col("event_type") == "view", "DescribeKey")
            .when(F.col("event_type") == "signup", "ExportKeyMaterial")
            .otherwise("Decrypt")
            .alias("operation"),
            F.concat(F.lit("k_"), F.lpad(_text(F.col("k")), 3, "0")).alias("key_id"),
            (user % 10 + 1).cast("bigint").alias("seed"),
            "event_type",
        )

    @cached_property
    def log(self) -> DataFrame:
        """Every request with its outcome and phase. The key table is bounded, the grants are not."""
        decided = policy.decided(self.requests, self.keys, self.grants, ("seed",), ())
        return decided.withColumn("phase", PERIOD.phase_of(F.col("timestamp")))

    @cached_property
    def compromised(self) -> DataFrame:
        """Sessions of administrators in the evaluated phase with two errors or more."""
        admins = self.administrators.select("seed", "operator_id")
        errors = (
            self.requests.where(PERIOD.belongs_to(EVALUATED, F.col("timestamp")))
            .where(F.col("event_type") == "error")
            .groupBy("seed", "operator_id", "session_id")
            .agg(F.count("*").alias("_errors"))
        )
        return errors.where(F.col("_errors") >= 2).join(admins, ["seed", "operator_id"], "left_semi").select("seed", "session_id")

    @cached_property
    def campaign(self) -> DataFrame:
        """Request rows of the compromised sessions."""
        return legitimate_of_evaluated_rows(self.requests).join(self.compromised, ["seed", "session_id"], "left_semi")

    @cached_property
    def legitimate(self) -> DataFrame:
        return legitimate_of_evaluated_rows(self.requests).join(self.compromised, ["seed", "session_id"], "left_anti")

    @cached_property
    def predictions(self) -> DataFrame:
        """Stand-in decisions and scores: fixed functions of two attributes, so that every metric has exact SQL."""
        scored = (
            self.log.where(F.col("phase") == EVALUATED)
            .groupBy("seed", "session_id")
            .agg(
                F.min("operator_id").alias("operator_id"),
                F.count("*").alias("events"),
                F.count_distinct("key_id").alias("distinct_keys"),
                F.count_if(F.col("outcome") != "success").alias("failures"),
            )
            .join(self.compromised.withColumn("_mark", F.lit(1)), ["seed", "session_id"], "left")
            .withColumn("compromised", F.col("_mark").isNotNull().cast("int"))
        )
        sigma, events, distinct = F.col("sigma"), F.col("events"), F.col("distinct_keys")
        wide, narrow = F.lit(4.0) + F.lit(8.0) * sigma, F.lit(5.0) + F.lit(4.0) * sigma
        none = F.lit(None).cast("double")
        entries = [
            _decision("rules", none, (F.col("failures") >= 2) & (events >= 5)),
            _decision("model_a", events / (events + F.lit(4.0) + F.lit(8.0) * sigma), events >= wide),
            _decision("model_b", distinct / (distinct + F.lit(5.0) + F.lit(4.0) * sigma), distinct >= narrow),
        ]
        return scored.withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in SIGMAS]))).select(
            "seed", "sigma", "session_id", "operator_id", "compromised", F.inline(F.array(*entries))
        )

    @cached_property
    def grid_log(self) -> DataFrame:
        """The log of every (seed, sigma): the warm-up once per seed, the evaluated phase with a campaign per sigma.

        At a higher sigma the campaign has fewer requests: of each compromised session, those whose number modulo 4 is
        at least 2 sigma.
        """
        number = F.substring("event_id", 7, 9).cast("bigint")
        evaluated = (
            self.log.where(F.col("phase") == EVALUATED)
            .join(self.compromised.withColumn("_mark", F.lit(1)), ["seed", "session_id"], "left")
            .withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in SIGMAS])))
            .where(F.col("_mark").isNull() | (number % 4 >= 2 * F.col("sigma")))
            .drop("_mark")
        )
        warmup = self.log.where(F.col("phase") == WARMUP).withColumn("sigma", F.lit(None).cast("double"))
        return warmup.unionByName(evaluated)

    @cached_property
    def grid_compromised(self) -> DataFrame:
        return self.compromised.withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in SIGMAS])))

    @cached_property
    def timings(self) -> DataFrame:
        user = F.col("user_id") % 3
        return self.numbered_events.where(F.col("value") > 0).select(
            F.when(user == 0, "rules").when(user == 1, "model_a").otherwise("model_b").alias("mechanism"),
            F.col("value").alias("microseconds_per_session"),
            (F.lit(1.0e6) / F.col("value")).alias("sessions_per_second"),
        )


def legitimate_of_evaluated_rows(requests: DataFrame) -> DataFrame:
    """Evaluated slice that keeps the event id, which the numbering needs as its last key."""
    kept = requests.withColumn("_event", F.col("event_id"))
    return legitimate_of_evaluated(kept, PERIOD).withColumnRenamed("_event", "event_id")


def _decision(mechanism: str, score: Column, alert: Column) -> Column:
    return F.struct(
        F.lit(mechanism).alias("mechanism"), score.alias("score"), alert.cast("int").alias("predicted")
    )
