"""The audit job: log to sessions, calibration on the warm-up, labelled sessions of the evaluated phase, alerts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.functions.calendar import EVALUATED, WARMUP
from keyvigil.operators import calibration, partition, rules, sessions
from keyvigil.schemas import ATTRIBUTES, IDENTIFIERS, LABEL
from keyvigil.session import written


class Pipeline:
    """Stages of one audit over a log with `seed` and `phase`, each lazy and built once.

    `run` names the columns of a run. The warm-up belongs to the replica (`seed`) alone; the evaluated sessions, their labels,
    the split and the alerts belong to the run, as a campaign differs with sigma. With ("seed", "sigma") the log carries
    sigma in the evaluated phase (and NULL in the warm-up), and the whole grid is this one job.

    `check()` runs the guards: it raises where a stage would have to decide about sessions without a profile, a label
    table or thresholds.

    With `store=True` the per-session aggregate is written as a table after the one pass over the log; profiles,
    thresholds and the evaluated sessions all read that table, so a large log is scanned and shuffled once.
    """

    def __init__(self, log: DataFrame, compromised: DataFrame, store: bool = True, run: Sequence[str] = ("seed",)):
        self.run = tuple(run)
        self.log = log
        self.compromised = compromised
        self.store = store

    @cached_property
    def counted(self) -> DataFrame:
        of_phases = self.log.where(F.col("phase").isNotNull())
        grouped = sessions.per_session(of_phases, (*self.run, "phase"))
        return written(grouped, "sessions", partitioned_by=("phase",)) if self.store else grouped

    def _phase(self, name: str) -> DataFrame:
        of_phase = self.counted.where(F.col("phase") == name).drop("phase")
        return of_phase.drop(*[column for column in self.run if column != "seed"]) if name == WARMUP else of_phase

    @cached_property
    def warmup(self) -> DataFrame:
        """Warm-up sessions with the six magnitude attributes: all that calibration and profiles need."""
        return sessions.with_rates(self._phase(WARMUP))

    @cached_property
    def windows(self) -> DataFrame:
        return sessions.usual_windows(self._phase(WARMUP))

    @cached_property
    def sources(self) -> DataFrame:
        return sessions.seen_sources(self._phase(WARMUP))

    @cached_property
    def profiles(self) -> DataFrame:
        return sessions.profiles(self._phase(WARMUP))

    @cached_property
    def warmup_sessions(self) -> DataFrame:
        full = sessions.with_history(self.warmup, self.windows, self.sources)
        return full.select("seed", *IDENTIFIERS, *ATTRIBUTES)

    @cached_property
    def thresholds(self) -> DataFrame:
        return calibration.thresholds(self.warmup)

    @cached_property
    def evaluated(self) -> DataFrame:
        rated = sessions.with_rates(self._phase(EVALUATED))
        full = sessions.with_history(rated, self.windows, self.sources)
        return sessions.with_label(full, self.compromised, self.run).select(*self.run, *IDENTIFIERS, *ATTRIBUTES, LABEL)

    @cached_property
    def alerts(self) -> DataFrame:
        """Every evaluated session with its flags and decision."""
        return rules.rule_predictions(self.evaluated, self.thresholds, run=self.run)

    @cached_property
    def split(self) -> DataFrame:
        return partition.written_split(self.evaluated, self.run)

    @cached_property
    def holdout(self) -> DataFrame:
        return partition.side(self.split, partition.HOLDOUT)

    @cached_property
    def train(self) -> DataFrame:
        return partition.side(self.split, partition.TRAIN)

    @cached_property
    def holdout_alerts(self) -> DataFrame:
        return rules.rule_predictions(self.holdout, self.thresholds, run=self.run)

    def check(self) -> Pipeline:
        """Raises on an operator without a profile and on a replica without thresholds; else returns the job itself."""
        calibration.require_threshold_set(self.thresholds)
        calibration.require_thresholds_of(self.evaluated, self.thresholds)
        sessions.require_profiles(self.evaluated, self.windows)
        return self
