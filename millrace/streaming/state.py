"""Keyed state over a stream with event time: stale jobs are reaped, failures in a row counted, calls held to a daily quota.

Events may come late, up to the watermark's delay. A key keeps those that the watermark has not passed and takes them in order of time once
it has, so results don't hang on how the stream is cut into batches, nor on restarts. A deadline of a key's state comes before all later events,
whether the watermark or the next event brings it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a fold tells: time in microseconds, the event's id or None, and the result.
Told = tuple[int, int | None, str]


class Fold(Protocol):
    """State of one key, a dictionary of plain values that is empty at first and is dropped when it is empty again."""

    def step(self, state: dict[str, Any], at: int, event: int, value: str | None) -> Iterable[Told]: ...

    def deadline(self, state: dict[str, Any]) -> int | None:
        """The time, in microseconds, behind which :meth:`expire` is due."""

    def expire(self, state: dict[str, Any]) -> Iterable[Told]: ...


@dataclass(frozen=True)
class Reaper:
    """A job ends with its first final status, or fails when ``silent`` seconds have passed since its last event. What comes later changes nothing.

    An ended job is forgotten ``forget`` seconds after its end, if that is given; events that come still later begin a new job.
    """

    final: tuple[str, ...]
    silent: int = 3600
    forget: int | None = None

    def step(self, state, at, event, value):
        if "ended" not in state:
            if value in self.final:
                state.clear()
                state["ended"] = at
                yield at, event, value
            else:
                state["last"] = at

    def deadline(self, state):
        if "ended" in state:
            return state["ended"] + self.forget * 1_000_000 if self.forget is not None else None
        return state["last"] + self.silent * 1_000_000 if "last" in state else None

    def expire(self, state):
        if "ended" in state:
            state.clear()
            return
        at = self.deadline(state)
        state.clear()
        state["ended"] = at
        yield at, None, "failed"


@dataclass(frozen=True)
class FailureCounter:
    """Tells ``deleted`` at the ``limit``-th failure in a row and counts anew; a success sets the count back. The value is ``fail`` or anything else."""

    limit: int = 3

    def step(self, state, at, event, value):
        n = state.get("n", 0) + 1 if value == "fail" else 0
        state.clear()
        if n == self.limit:
            yield at, event, "deleted"
        elif n:
            state["n"] = n

    def deadline(self, state):
        return None

    def expire(self, state):
        return ()


@dataclass(frozen=True)
class DailyQuota:
    """Tells ``allowed`` or ``refused`` for each call. The value is the call's own limit a day; null or none above 0 is ``limit``. Days are those of UTC."""

    limit: int = 1000

    def step(self, state, at, event, value):
        day, limit = at // 86_400_000_000, int(value) if value and int(value) > 0 else self.limit
        used = state.get("used", 0) if state.get("day") == day else 0
        state |= {"day": day, "used": min(used + 1, limit) if used < limit else used}
        yield at, event, "allowed" if used < limit else "refused"

    def deadline(self, state):
        return (state["day"] + 1) * 86_400_000_000 - 1 if state else None

    def expire(self, state):
        state.clear()
        return ()


#: What a remote status makes of a job that has not ended. What is not listed, as ``unavailable``, leaves it as it is.
TRANSITIONS = {"pending": "pending", "running": "running", "completed": "completed", "failed": "failed", "cancelled": "cancelled", "not_found": "failed"}
ENDED = ("completed", "failed", "cancelled")


@dataclass(frozen=True)
class StatusMachine:
    """Tells each change of a job's status, which is ``pending`` at first. An ended job takes no late result; a lost one has failed.

    An ended job is forgotten ``forget`` seconds after its end, if that is given.
    """

    forget: int | None = None

    def step(self, state, at, event, value):
        now = state.get("now", "pending")
        new = now if now in ENDED else TRANSITIONS.get(value, now)
        state["now"] = new
        if new != now:
            state["at"] = at
            yield at, event, new

    def deadline(self, state):
        return state["at"] + self.forget * 1_000_000 if self.forget is not None and state.get("now") in ENDED else None

    def expire(self, state):
        state.clear()
        return ()


def advance(fold: Fold, waiting: list[tuple[int, int, str | None]], state: dict[str, Any], until: int) -> tuple[list[Told], list[tuple[int, int, str | None]]]:
    """What the events up to ``until`` tell in order of time and id, with deadlines in between, and the events that still wait."""
    out: list[Told] = []
    waiting = sorted(waiting, key=lambda e: (e[0], e[1], e[2] or ""))
    due = [e for e in waiting if e[0] <= until]
    for at, event, value in due:
        while (limit := fold.deadline(state)) is not None and limit < at:
            out += fold.expire(state)
        out += fold.step(state, at, event, value)
    while (limit := fold.deadline(state)) is not None and limit < until:
        out += fold.expire(state)
    return out, waiting[len(due) :]


def follow(events: DataFrame, key: str, at: str, event: str, value: Column, fold: Fold, delay: str = "10 minutes") -> DataFrame:
    """Rows ``(key, at, event, told)`` of a stream, in append mode. ``event`` is a whole number that orders events of one time.

    Events without a time or key are left out, and so are those that come later than ``delay`` behind the latest. A key keeps its events of the
    last ``delay`` and its state; nothing else is kept.
    """
    rows = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(event).cast("long").alias("event"), value.cast("string").alias("value"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    rows = rows.where("key is not null and at is not null and event is not null").withWatermark("at", delay)
    kind = rows.schema["key"].dataType.simpleString()

    def run(own: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        waiting, state = (json.loads(x) for x in kept.get) if kept.exists else ([], {})
        until = max(kept.getCurrentWatermarkMs(), 0) * 1000
        for f in frames:
            values = (v if isinstance(v, str) else None for v in f["value"])
            waiting += map(list, zip(f["us"].tolist(), f["event"].tolist(), values))
        out, waiting = advance(fold, waiting, state, until)
        if not waiting and not state:
            if kept.exists:
                kept.remove()
        else:
            kept.update((json.dumps(waiting), json.dumps(state)))
            times = [t for t in (fold.deadline(state), waiting[0][0] if waiting else None) if t is not None]
            if times:
                kept.setTimeoutTimestamp(max(min(times) // 1000 + 1, until // 1000 + 1))
        if out:
            at, event, result = zip(*out)
            yield pd.DataFrame({"key": [own[0]] * len(out), "at": at, "event": pd.Series(event, dtype="object"), "told": result})

    told = rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, at bigint, event long, told string", "waiting string, state string", "append", GroupStateTimeout.EventTimeTimeout)
    told = told.withColumn("at", F.timestamp_micros("at"))
    return told.withColumnRenamed("key", key)
