"""Structured Streaming forms (ST) of the stateful operators. Late rows (past the watermark) are dropped by the state operators and
counted in the query's progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream; the query's checkpoint remembers what has been read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def publish(events: DataFrame, ts: str = "ts", content: str = "content", watermark: str = WATERMARK) -> DataFrame:
    """ST1: the first event of each content hash within the watermark."""
    return events.withWatermark(ts, watermark).withColumn("content_hash", F.sha2(content, 256)).dropDuplicatesWithinWatermark(["content_hash"])


def subscribe(events: DataFrame, projects: list[str] | None = None, after_id: int | None = None) -> DataFrame:
    """ST2: events of some projects, after an id."""
    out = events if projects is None else events.where(F.col("project").isin(projects))
    return out if after_id is None else out.where(F.col("event_id") > after_id)


def bus(items: DataFrame, tags: list[str], agent: str | None = None) -> DataFrame:
    """ST3: items with any of the tags, of one agent if asked."""
    out = items.where(F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False)))
    return out if agent is None else out.where(F.col("source_agent") == agent)


def event_log(events: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """ST4: each event id once."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["event_id"])


def replay(log: DataFrame, project: str, since: str, ts: str = "ts") -> DataFrame:
    """ST4: a written log's events of a project since a time, in order."""
    return log.where((F.col("project") == project) & (F.col(ts) >= F.lit(since).cast("timestamp"))).orderBy(ts, "event_id")


def _micros(s: pd.Series) -> np.ndarray:
    return s.dt.tz_localize(None).to_numpy().astype("datetime64[us]").astype(np.int64) if getattr(s.dt, "tz", None) is not None else s.to_numpy().astype("datetime64[us]").astype(np.int64)


def _fold(step: Callable, keep_us: int) -> Callable:
    """A keyed fold over rows in time order whose state is a list of times of the last keep_us microseconds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        flags = []
        for t in _micros(rows["ts"]).tolist():
            ok, times = step(times, t)
            flags.append(ok)
        state.update((times,))
        last = max(times) if times else 0
        state.setTimeoutTimestamp(max(last // 1000 + keep_us // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "accepted": flags})

    return run


def _apply(events: DataFrame, key: str, step: Callable, keep_us: int, watermark: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    keyed = events.withWatermark("ts", watermark).select(F.col(key).alias("key"), "event_id", "ts").groupBy("key")
    return keyed.applyInPandasWithState(_fold(step, keep_us), f"key {kind}, event_id long, accepted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def kept_rows(events: DataFrame, key: str, seconds: float, watermark: str = WATERMARK) -> DataFrame:
    """ST5: accepted is false within `seconds` of the last kept row of the key; the state is that row's time."""
    gap = int(seconds * 1e6)

    def step(times: list[int], t: int) -> tuple[bool, list[int]]:
        return (True, [t]) if not times or abs(t - times[-1]) > gap else (False, times)

    return _apply(events, key, step, gap, watermark)


def rate_limit(events: DataFrame, key: str, most: int, seconds: float, watermark: str = WATERMARK) -> DataFrame:
    """ST6: accepted while fewer than `most` accepted events of the key lie in the window."""
    span = int(seconds * 1e6)

    def step(times: list[int], t: int) -> tuple[bool, list[int]]:
        times = [x for x in times if t - x < span]
        return (True, [*times, t]) if len(times) < most else (False, times)

    return _apply(events, key, step, span, watermark)


def rollups(events: DataFrame, sliding_days: int | None = None, watermark: str = "1 day") -> DataFrame:
    """ST7: counts for each principal and type in days, or in windows of several days that start every day."""
    w = F.window("ts", "1 day") if sliding_days is None else F.window("ts", f"{sliding_days} days", "1 day")
    counts = events.withWatermark("ts", watermark).groupBy(w.alias("w"), "principal_id", "event_type").agg(F.count("*").alias("n"))
    return counts.select("principal_id", "event_type", F.to_date("w.start").alias("first_day"), "n")


def sessions(events: DataFrame, gap: str, watermark: str = WATERMARK) -> DataFrame:
    """ST8: sessions of a key that end after an idle gap."""
    s = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "principal_id").agg(F.count("*").alias("n"))
    return s.select("principal_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def every_n(events: DataFrame, scope: str, n: int, watermark: str = WATERMARK) -> DataFrame:
    """ST9: a row each time the number of a scope's events crosses a multiple of n."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        if now // n > before // n:
            yield pd.DataFrame({"scope": [key[0]], "count": [now]})

    kind = events.schema[scope].dataType.simpleString()
    keyed = events.select(F.col(scope).alias("scope"), "event_id").groupBy("scope")
    return keyed.applyInPandasWithState(run, f"scope {kind}, count long", "n long", "append", GroupStateTimeout.NoTimeout)


def link_new_sessions(stream: DataFrame, known_path: str, edges_path: str, checkpoint: str, hours: float = 168.0, least: int = 5):
    """ST10: each micro-batch of sessions (id, ts, vocabulary) is linked among itself and with the stored ones near it in time, then stored."""
    from engram.operators.joins import link_sessions

    def batch(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        new = new.persist()
        ends = new.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        if ends["a"] is not None:
            try:
                known = spark.read.parquet(known_path).where(f"batch <> {batch_id}")
            except Exception as e:  # the first batch has no store yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                known = None
            rows = new
            if known is not None:
                span = F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND")
                rows = new.unionByName(known.where((F.col("ts") >= F.lit(ends["a"]) - span) & (F.col("ts") <= F.lit(ends["b"]) + span)).select(*new.columns))
            edges = link_sessions(rows, hours, least)
            mine = new.select("id")
            own = edges.join(mine.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(edges.join(mine.withColumnRenamed("id", "target_id"), "target_id", "left_semi")).distinct()
            own.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(edges_path)
            new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(known_path)
        new.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_now(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there into parquet and read it back."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(out)
