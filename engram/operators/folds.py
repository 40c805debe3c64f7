"""Ordered folds that no window expresses: kept-row dedup, rate limits, greedy fits, running chunk state.

Rows are dealt by key, sorted and streamed; a fold holds the state of one key at a time, and every row's result leaves with its row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.names import fresh


def fold(rows: DataFrame, keys: list[str], order: list[Column], read: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], made: dict[str, str]) -> DataFrame:
    """rows with the columns `made` (name: type): step(state, values of `read`) returns the next state and these columns' values, row by row in order."""
    rest = [c for c in rows.columns if c not in made]
    sort = {fresh(f"o{i}", rows.columns): c for i, c in enumerate(order)}
    names = list(made)
    schema = rows.select(*rest, *[F.lit(None).cast(t).alias(n) for n, t in made.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for key, values in zip(zip(*[batch[k].to_pylist() for k in keys]), zip(*[batch[c].to_pylist() for c in read])):
                if state is None or key != last:
                    last, state = key, start()
                state, row = step(state, values)
                out.append(row)
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], *[pa.array(c, types[n]) for n, c in zip(names, columns)]], names=[*rest, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    types = {n: to_arrow_type(schema[n].dataType) for n in names}
    dealt = rows.select(*rest, *[c.alias(n) for n, c in sort.items()]).repartition(*keys).sortWithinPartitions(*keys, *sort)
    return dealt.drop(*sort).mapInArrow(run, schema)


def kept_rows(rows: DataFrame, keys: list[str], seconds: float, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Rows that aren't within `seconds` of an earlier kept row of their key, as (keys, event_id)."""
    at = fresh("at", rows.columns)
    narrow = rows.select(*keys, key, F.unix_micros(F.col(ts).cast("timestamp")).alias(at))

    def step(last: tuple, values: tuple) -> tuple[tuple, tuple]:
        keep = not last or values[0] - last[0] > int(seconds * 1e6)
        return ((values[0],) if keep else last), (keep,)

    kept = fresh("kept", narrow.columns)
    return fold(narrow, keys, [F.col(at), F.col(key)], [at], tuple, step, {kept: "boolean"}).where(kept).select(*keys, key)


def rate_limited(rows: DataFrame, principal: str, most: int, seconds: float, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Each call accepted or not under a sliding window in which only accepted calls count; the state is at most `most` times."""
    at = fresh("at", rows.columns)
    narrow = rows.select(principal, key, F.unix_micros(F.col(ts).cast("timestamp")).alias(at))

    def step(times: deque, values: tuple) -> tuple[deque, tuple]:
        while times and values[0] - times[0] >= seconds * 1e6:
            times.popleft()
        ok = len(times) < most
        if ok:
            times.append(values[0])
        return times, (ok,)

    return fold(narrow, [principal], [F.col(at), F.col(key)], [at], deque, step, {"accepted": "boolean"}).select(principal, key, "accepted")


def greedy_fit(rows: DataFrame, group: str, size: str, budget: int, order: list[Column], key: str) -> DataFrame:
    """Rows chosen in order; one that doesn't fit is skipped and the next is tried. The state is what is used."""
    chosen = fresh("chosen", rows.columns)
    sort = [f"_o{i}" for i in range(len(order))]
    narrow = rows.select(F.col(group), F.col(size), F.col(key), *[c.alias(n) for c, n in zip(order, sort)])  # texts and the like stay behind

    def step(used: int, values: tuple) -> tuple[int, tuple]:
        fits = values[0] is not None and used + values[0] <= budget
        return used + (values[0] if fits else 0), (fits,)

    return fold(narrow, [group], [*map(F.col, sort), F.col(key)], [size], int, step, {chosen: "boolean"}).where(chosen).select(group, key)


def chunk_state(rows: DataFrame, stream: str, order: str, drift_below: float = 0.3) -> DataFrame:
    """Running state of each stream after every chunk (order, embedding or null, score): topic starts at zero and moves by 1 / (i + 1) of the way, i from 1
    and counting skipped chunks; drift is a cosine to the state before of less than `drift_below`; topic_norm is that of the state so far."""

    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        i, total, topic = state
        e, score = values
        i, total, drift = i + 1, total + score, False
        if e is not None:
            v = np.asarray(e, float)
            topic = np.zeros(len(v)) if topic is None else topic
            size = np.linalg.norm(topic) * np.linalg.norm(v)
            drift = bool(size > 0 and topic @ v / size < drift_below)
            topic = topic + (v - topic) / (i + 1)
        norm = 0.0 if topic is None else float(np.linalg.norm(topic))
        return (i, total, topic), (i, total / i, drift, norm)

    made = {"seen": "long", "mean_score": "double", "drift": "boolean", "topic_norm": "double"}
    return fold(rows.select(stream, order, "embedding", "score"), [stream], [F.col(order)], ["embedding", "score"], lambda: (0, 0.0, None), step, made).select(stream, order, *made)


def chunk_boundaries(rows: DataFrame, stream: str, order: str, most: int = 50, base: float = 0.95, floor: float = 0.1, drift_below: float = 0.3) -> DataFrame:
    """rows (stream, order, embedding or null, entities or null, score) with the state after each chunk: seen (i), topic (starting at zero, it moves by 1 / (i + 1) of the way),
    drift (the cosine of a chunk to a state before of the same length is below `drift_below`), score_min, score_max, score_mean, decay (base to the i, `floor` at
    least) and entities_kept: the `most` entities met last, a chunk's own first in their order, then those of before, equal ones (trimmed, without regard to case) as last spelt.

    The state of a stream is one vector and `most` entities. An embedding of another length than the first leaves the topic as it is; blank entities don't count.
    """

    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        i, topic, low, high, total, held = state
        e, entities, score = values
        i, drift = i + 1, False
        if e is not None and all(x is not None for x in e):
            v = np.asarray(e, float)
            before = np.zeros(len(v)) if topic is None else topic
            if len(before) == len(v):
                size = np.linalg.norm(before) * np.linalg.norm(v)
                drift = bool(i > 1 and (before @ v / size if size > 0 else 0.0) < drift_below)
                topic = before + (v - before) / (i + 1)
        merged: dict[str, str] = {}
        for name in [x.strip() for x in entities or () if x] + held:
            if name:
                merged.setdefault(name.lower(), name)
        held = list(merged.values())[:most]
        low, high, total = (score, score, score) if low is None else (min(low, score), max(high, score), total + score)
        shown = None if topic is None else topic.tolist()
        return (i, topic, low, high, total, held), (i, shown, drift, low, high, total / i, max(floor, base**i), held)

    made = {"seen": "long", "topic": "array<double>", "drift": "boolean", "score_min": "double", "score_max": "double", "score_mean": "double", "decay": "double", "entities_kept": "array<string>"}
    narrow = rows.select(stream, order, "embedding", "entities", "score").where("score IS NOT NULL")
    return fold(narrow, [stream], [F.col(order)], ["embedding", "entities", "score"], lambda: (0, None, None, None, 0.0, []), step, made).select(stream, order, *made)
