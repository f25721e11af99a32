"""Lives of jobs: from their first event to their end, in a stream or in a table.

A job ends by an event that ends it, by a failure after its last retry, or by
silence: if nothing is heard of a running job for too long, it is interrupted.
Events may come late and in any order; each waits until the watermark has passed
it, and then they are taken in their own order. So the stream tells what the
table would, whatever came when.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDS = ("completed", "cached", "excluded", "unclassified", "qa_failed", "cancelled")
RUNNING = ("running", "analyzed")
LIVES = "job long, began long, ended long, status string, attempts int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class Life(NamedTuple):
    """What is known of a job: times in milliseconds, and retries so far."""

    began: int
    last: int
    status: str
    attempts: int
    retried: int


class Rules(NamedTuple):
    silence: int  # milliseconds
    retries: int

    def silent_from(self, life: Life | None) -> int | None:
        """When a job that says nothing more is interrupted."""
        return life.last + self.silence if life and life.status in RUNNING else None

    def take(self, life: Life | None, at: int, status: str) -> tuple[Life | None, list[tuple]]:
        """The life after an event, and the ends (began, ended, status, attempts) it tells of."""
        told = []
        silent = self.silent_from(life)
        if silent is not None and at > silent:
            told.append((life.began, silent, "interrupted", life.attempts))
            life = None
        life = (life or Life(at, at, status, 0, 0))._replace(last=at, status=status)
        if status == "running":
            life = life._replace(attempts=life.attempts + 1)
        over = status in ENDS or status == "failed" and life.retried >= self.retries
        if over:
            return None, [*told, (life.began, at, status, life.attempts)]
        return (life._replace(retried=life.retried + 1) if status == "failed" else life), told


class _Watch(StatefulProcessor):
    """State of a job: its life, and events that wait for the watermark. A timer
    is set for what is next, and state goes with the job's end."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "began long, last long, status string, attempts int, retried int")
        self.waiting = handle.getListState("waiting", "at long, sequence long, status string")

    def _next(self, life: Life | None, waiting: list[tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        times = [w[0] for w in waiting[:1]] + [t for t in (self.rules.silent_from(life),) if t is not None]
        if times:
            self.handle.registerTimer(min(times))

    def _waiting(self) -> list[tuple]:
        return sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []

    def _life(self) -> Life | None:
        return Life(*self.life.get()) if self.life.exists() else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = sorted([*self._waiting(), *((r["at_ms"], r["sequence"], r["status"]) for r in rows)])
        self.waiting.put(waiting)
        self._next(self._life(), waiting)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, life, waiting, told = timerValues.getCurrentWatermarkInMs(), self._life(), self._waiting(), []
        ready = [w for w in waiting if w[0] < now]
        for at, _, status in ready:
            life, ends = self.rules.take(life, at, status)
            told += ends
        silent = self.rules.silent_from(life)
        if silent is not None and silent < now:
            told.append((life.began, silent, "interrupted", life.attempts))
            life = None
        waiting = waiting[len(ready) :]
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        self.life.update(tuple(life)) if life else self.life.clear()
        self._next(life, waiting)
        return iter([Row(job=key[0], began=b, ended=e, status=s, attempts=n) for b, e, s, n in told])


def watched(events: DataFrame, silence_ms: int, retries: int, late: str) -> DataFrame:
    """events: a stream of (job, at timestamp, sequence, status). A stream of
    lives (job, began, ended, status, attempts), times in milliseconds, as they
    end. Events more than `late` behind the newest are not waited for. The
    session's state store has to be RocksDB (see STORE)."""
    rows = events.select("job", "at", F.unix_millis("at").alias("at_ms"), F.col("sequence").cast("long"), "status").withWatermark("at", late)
    return rows.groupBy("job").transformWithState(_Watch(Rules(silence_ms, retries)), LIVES, "Append", "EventTime")


def _folded(rules: Rules, horizon: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, life = None, None

        def silent() -> list[tuple]:
            at = rules.silent_from(life)
            return [] if at is None or at >= horizon else [(now, life.began, at, "interrupted", life.attempts)]

        names = ["job", "began", "ended", "status", "attempts"]
        for batch in batches:
            out = []
            for job, at, status in zip(batch["job"], batch["at_ms"], batch["status"]):
                if job != now:
                    out += silent()
                    now, life = job, None
                life, ends = rules.take(life, at, status)
                out += [(job, *e) for e in ends]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(silent(), columns=names)

    return of


def lives(events: DataFrame, silence_ms: int, retries: int, late_ms: int = 0) -> DataFrame:
    """The same of a whole table, as a stream of it would tell: what happened up
    to late_ms before the newest event. Jobs are sorted into partitions and read
    in one pass, so a job with very many events is no group in memory."""
    rows = events.select("job", F.unix_millis("at").alias("at_ms"), F.col("sequence").cast("long").alias("sequence"), "status")
    newest = rows.agg(F.max("at_ms")).first()[0]
    if newest is None:
        return rows.sparkSession.createDataFrame([], LIVES)
    horizon = newest - late_ms
    ready = rows.filter(F.col("at_ms") < horizon).repartition("job").sortWithinPartitions("job", "at_ms", "sequence", "status")
    return ready.mapInPandas(_folded(Rules(silence_ms, retries), horizon), LIVES)
