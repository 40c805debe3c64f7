"""Ordered folds over streams by transformWithState (ST5, ST6, ST8): list and value state in RocksDB, event-time timers.

A key's rows wait in a list state until the watermark has passed their tick, so rows that come late, but within the watermark, take their
place in the order; a timer then folds them, tick by tick, and emits each once. When a key has been silent for `keep` microseconds
of event time another timer drops its state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class OrderedFold(StatefulProcessor):
    """step(state, rows of one tick) -> (state, a tuple for each row); state: whatever JSON holds; a row: [at, event_id, *read]."""

    def __init__(self, start: Any, step: Callable, made: list[str], keep: int, tick: int) -> None:
        self.start, self.step, self.made, self.keep, self.tick = start, step, made, keep, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.folded = handle.getValueState("folded", "last long, state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in frame["row"]]
        self.waiting.appendList([(r,) for r in new])
        self.handle.registerTimer(self.end(min(json.loads(r)[0] for r in new)))
        return iter(())

    def end(self, at: int) -> int:
        """The millisecond at which the tick of a time is over."""
        return -(-(at // self.tick + 1) * self.tick // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(json.loads(r[0]) for r in self.waiting.get())
        due = [r for r in rows if self.end(r[0]) <= now]
        last, state = (lambda f: (f[0], json.loads(f[1])))(self.folded.get()) if self.folded.exists() else (None, None)
        if due:
            out, first = [], 0
            for i in range(1, len(due) + 1):
                if i == len(due) or due[i][0] // self.tick != due[first][0] // self.tick:
                    if state is None or due[first][0] - last > self.keep:
                        state = self.start
                    state, answers = self.step(state, due[first:i])
                    out += [(r[1], r[0], *a) for r, a in zip(due[first:i], answers)]
                    first, last = i, due[i - 1][0]
            if len(due) < len(rows):
                self.waiting.put([(json.dumps(r),) for r in rows[len(due) :]])
                self.handle.registerTimer(self.end(rows[len(due)][0]))
            else:
                self.waiting.clear()
            self.folded.update((last, json.dumps(state)))
            if (last + self.keep) // 1000 + 1 > now:
                self.handle.registerTimer((last + self.keep) // 1000 + 1)
            elif len(due) == len(rows):
                self.folded.clear()
            yield pd.DataFrame(out, columns=["event_id", "at", *self.made]).assign(key=key[0])
        elif not rows and last is not None and last + self.keep < now * 1000:
            self.folded.clear()

    def close(self) -> None:
        pass


def ordered_fold(events: DataFrame, key: str, read: list[str], start: Any, step: Callable, made: dict[str, str], keep: int, tick: int = 1, watermark: str = "1 hour") -> DataFrame:
    """events (key, event_id, ts, read...) as (key, event_id, at, made...), each row once the watermark has passed its tick of `tick` microseconds."""
    kind = events.schema[key].dataType.simpleString()
    row = F.to_json(F.array(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.col("event_id").cast("string"), *[F.col(c).cast("string") for c in read]))
    rows = events.withWatermark("ts", watermark).select(F.col(key).alias("key"), "ts", row.alias("row"))
    numbered = rows.withColumn("row", F.regexp_replace("row", r'^\["(-?\d+)","(-?\d+)"', "[$1,$2"))  # time and id as numbers, for the order
    schema = f"event_id long, at long, {', '.join(f'{n} {t}' for n, t in made.items())}, key {kind}"
    return numbered.groupBy("key").transformWithStateInPandas(OrderedFold(start, step, list(made), keep, tick), schema, "append", "eventtime")


def kept_rows(events: DataFrame, key: str, seconds: float, watermark: str = "1 hour") -> DataFrame:
    """ST5: accepted is false within `seconds` of the last kept row of the key. The state is one time, dropped when it no longer matters."""
    gap = int(seconds * 1e6)

    def step(last: list, rows: list) -> tuple[list, list]:
        out = []
        for at, *_ in rows:
            ok = not last or at - last[0] > gap
            last = [at] if ok else last
            out.append((ok,))
        return last, out

    return ordered_fold(events, key, [], [], step, {"accepted": "boolean"}, gap, 1, watermark)


def rate_limit(events: DataFrame, key: str, most: int, seconds: float, watermark: str = "1 hour") -> DataFrame:
    """ST6: accepted while fewer than `most` accepted events of the key lie in the window; the state is at most `most` times."""
    span = int(seconds * 1e6)

    def step(times: list, rows: list) -> tuple[list, list]:
        out = []
        for at, *_ in rows:
            times = [t for t in times if at - t < span]
            ok = len(times) < most
            times = [*times, at] if ok else times
            out.append((ok,))
        return times, out

    return ordered_fold(events, key, [], [], step, {"accepted": "boolean"}, span, 1, watermark)


def export_alerts(events: DataFrame, key: str, seconds: int = 3600, burst: int = 50, sweep: int = 5, watermark: str = "1 hour") -> DataFrame:
    """ST6: rows of exports (key, event_id, ts, project) at which a principal has more than `burst` exports, or has touched `sweep` projects, in the
    seconds up to and including the row's: (key, event_id, in_window, projects, is_burst, is_sweep). The state is the window, where it begins and its projects' counts: a row
    enters and leaves it once."""
    span = seconds * 1_000_000

    def step(state: list, rows: list) -> tuple[list, list]:
        window, head, count = state or ([], 0, {})
        second = rows[0][0] // 1_000_000
        while head < len(window) and second - window[head][0] // 1_000_000 > seconds:
            p, head = window[head][1], head + 1
            if p is not None:
                count[p] -= 1
                if not count[p]:
                    del count[p]
        if head > len(window) // 2:
            window, head = window[head:], 0
        for r in rows:
            window.append([r[0], r[2]])
            if r[2] is not None:
                count[r[2]] = count.get(r[2], 0) + 1
        n, projects = len(window) - head, len(count)
        return [window, head, count], [(n, projects, n > burst, projects >= sweep)] * len(rows)

    made = {"in_window": "long", "projects": "long", "is_burst": "boolean", "is_sweep": "boolean"}
    return ordered_fold(events, key, ["project"], [], step, made, span + 1_000_000, 1_000_000, watermark).where("is_burst OR is_sweep")


def think_times(events: DataFrame, key: str, duration_ms: str, keep_hours: float = 24.0, watermark: str = "1 hour") -> DataFrame:
    """ST8: milliseconds from the end of the session's previous call to the start of this one, 0 at least; null for the first, and for one more than `keep_hours`
    after the last. The state is one number."""

    def step(end: list, rows: list) -> tuple[list, list]:
        out = []
        for at, _, duration in rows:
            out.append((None if not end or end[0] is None else max(0.0, at / 1000.0 - end[0]),))
            end = [None if duration is None else at / 1000.0 + float(duration)]
        return end, out

    out = ordered_fold(events, key, [duration_ms], [], step, {"think_ms": "double"}, int(keep_hours * 3.6e9), 1, watermark)
    return out.withColumn("think_ms", F.round("think_ms", 1))
