"""The state of tasks in event time, with timers.

An event waits in its task's state until the watermark has passed it and is then applied in order of (time, id), so that the
result does not depend on how events arrive: late ones within the delay count, repeated ones (same time and id) count once, later
ones are dropped by the watermark. What waits is bounded by the delay; beside it a task keeps one row. Between events timers
run: a running task without news for ``zombie`` minutes goes back to pending, to start again at its last successful stage, at
most ``resumes`` times, and has then failed; a run that takes ``deadline`` minutes has failed. State is that of the checkpoint
folder: a query that starts again goes on with it. Needs the RocksDB state store (``prepared``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Minutes without news, resumes, minutes of a run.
ZOMBIE, RESUMES, DEADLINE = 5, 3, 100
ENDED = ("completed", "failed", "cancelled")
_STATE = "status string, current_stage string, stage_status string, progress int, last_success string, attempts long, resumes long, n_events long, n_refused long, reason string, started long, updated long, version long"
_EVENT = "stage string, status string, progress int, success boolean, attempt boolean"


@dataclass
class Task:
    """Times are milliseconds; ``version`` counts the rows written."""

    status: str = "pending"
    current_stage: str | None = None
    stage_status: str | None = None
    progress: int | None = None
    last_success: str | None = None
    attempts: int = 0
    resumes: int = 0
    n_events: int = 0
    n_refused: int = 0
    reason: str | None = None
    started: int | None = None
    updated: int | None = None
    version: int = 0


@dataclass(frozen=True)
class Rules:
    zombie: int = ZOMBIE * 60_000
    resumes: int = RESUMES
    deadline: int = DEADLINE * 60_000
    #: Stages that may follow a stage (None: the first one); no rules at all if it is None.
    allowed: dict[str | None, frozenset[str]] | None = None

    def due(self, t: Task) -> int | None:
        """When the task's next timer runs out."""
        return min(t.updated + self.zombie, t.started + self.deadline) if t.status == "running" else None

    def expire(self, t: Task, now: int) -> None:
        """A timer that ran out before ``now`` takes effect; at most one does, as none runs after it."""
        at = self.due(t)
        if at is None or at >= now:
            return
        if at == t.started + self.deadline:
            t.status, t.reason = "failed", "deadline"
        elif t.resumes < self.resumes:
            t.status, t.reason, t.resumes = "pending", "zombie", t.resumes + 1
        else:
            t.status, t.reason = "failed", "zombie"
        t.updated = at

    def apply(self, t: Task, at: int, stage: str, status: str, progress: int | None, success: bool, attempt: bool) -> None:
        """One event. A task that has ended, or a stage that may not follow the current one, refuses it."""
        self.expire(t, at)
        t.n_events += 1
        if t.status in ENDED or (self.allowed is not None and stage != t.current_stage and stage not in self.allowed.get(t.current_stage, ())):
            t.n_refused += 1
            return
        if t.status != "running":
            t.started = at
        t.status = status if status in ("failed", "cancelled") or (stage == status == "completed") else "running"
        t.reason = status if t.status in ("failed", "cancelled") else None
        t.current_stage, t.stage_status, t.progress, t.updated = stage, status, progress, at
        t.attempts += bool(attempt)
        if success:
            t.last_success = stage

    def fold(self, t: Task, events: Iterable[tuple], upto: int) -> Task:
        """Events (time, id, stage, status, progress, success, attempt) in order of time and id, then the timers up to ``upto``."""
        for at, _, *event in sorted(events, key=lambda e: e[:2]):
            self.apply(t, at, *event)
        self.expire(t, upto)
        return t


class TaskMachine(StatefulProcessor):
    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _STATE)
        self.waiting = handle.getMapState("waiting", "at long, id string", _EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            for at, event_id, *event in b[["ev_at", "ev_id", "ev_stage", "ev_status", "ev_progress", "ev_success", "ev_attempt"]].itertuples(index=False, name=None):
                stage, status, progress, success, attempt = event
                self.waiting.updateValue((int(at), event_id), (stage, status, None if pd.isna(progress) else int(progress), bool(success), bool(attempt)))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(int(first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [(*k, *v) for k, v in self.waiting.iterator()]
        ready = [e for e in waiting if e[0] <= now]
        before = self.task.get()
        t = Task(*before) if before else Task()
        old = astuple(t)
        self.rules.fold(t, ready, now)
        for e in ready:
            self.waiting.removeKey(e[:2])
        due = self.rules.due(t)
        later = [e[0] for e in waiting if e[0] > now] + ([due + 1] if due is not None else [])
        if later:
            self.handle.registerTimer(max(min(later), now + 1))
        if astuple(t) != old:
            t.version += 1
            self.task.update(astuple(t))
            names = [c.split()[0] for c in _STATE.split(", ")]
            yield pd.DataFrame({"key": [key[0]], **{n: [v] for n, v in zip(names, astuple(t), strict=True)}})

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> None:
    """The state store that timers need, for the session's queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def states(events: DataFrame, key: str, at: str, event_id: str, stage: Column, status: Column, progress: Column, success: Column, attempt: Column, rules: Rules | None = None, delay: str = "10 minutes") -> DataFrame:
    """A stream of tasks' states, one row a change (``version`` rises): key as text, status, stage, last success, attempts, resumes, refused events, reason, times in milliseconds.

    Events without a key, a time or a stage are left out. On what the watermark has not passed nothing is said.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & stage.isNotNull()).withWatermark(at, delay)
    # Names without a leading underscore: rows reach the processor as named tuples.
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(at).alias("ev_time"), F.unix_millis(at).alias("ev_at"), F.coalesce(F.col(event_id).cast("string"), F.lit("")).alias("ev_id"), stage.alias("ev_stage"), F.coalesce(status, F.lit("running")).alias("ev_status"), progress.cast("int").alias("ev_progress"), F.coalesce(success, F.lit(False)).alias("ev_success"), F.coalesce(attempt, F.lit(False)).alias("ev_attempt"))
    return rows.groupBy("key").transformWithStateInPandas(TaskMachine(rules or Rules()), f"key string, {_STATE}", "Update", "eventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each task among the rows that ``states`` wrote."""
    rest = [c for c in changes.columns if c not in ("key", "version")]
    return changes.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("key", "_r.*")
