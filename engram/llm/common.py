"""Helpers shared by the training-data operators: checkpoints, text buffers, word and hash kernels.

The kernels work on whole Arrow batches with numpy: a batch's texts are one byte array plus
row offsets, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.names import fresh  # noqa: F401

U64 = np.uint64
#: Bytes of text handled at once by the numpy kernels (a longer text is handled alone).
CHUNK = 1 << 20


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes that a Python worker is handed at once (a row is never split), unless the session has a smaller bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(name, "64m").lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = bound.rstrip("bkmg")
    now = int(digits) * units.get(bound[len(digits) :], 1)
    if not 0 < now <= size:
        spark.conf.set(name, str(size))


_KEPT: dict[tuple, Any] = {}


def kept_in_worker(make: Callable, *args: Any, key: Any = None) -> Any:
    """make(*args), kept in this Python worker until a task asks for something else: one thing at a time. key: instead of args that can't be one."""
    key = (make.__module__, make.__qualname__, args if key is None else key)
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def release(kept: bool = False) -> None:
    """Give what a finished task's arrays held back to the system, so that reused Python workers stay small; with what is kept, unless the operator uses it."""
    if not kept:
        _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a local session for which none is named gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder: lineage ends here."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from Parquet files in the shared checkpoint folder: lineage ends here."""
    spark = df.sparkSession
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts (one small aggregate over the column)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0)).alias("b")).first()["b"])


def group_count(total_bytes: int, each: int, least: int = 12) -> int:
    """How many groups hold total_bytes at about `each` bytes a group."""
    return max(least, -(-total_bytes // each))


def part_of(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def byte_set(keep: bytes | range | set[int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(keep)] = True
    return lut


#: Everything but space and \t \n \v \f \r.
NOT_SPACE = ~byte_set({0x20, *range(0x09, 0x0E)})
#: Digits, a-z and all bytes of non-ASCII characters, after lower-casing A-Z.
ALNUM = byte_set({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of maximal runs of kept bytes within rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = keep[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
#: A fixed random 64-bit value for each byte.
BYTE_CODES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R, U64), np.full(n, _R_INV, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    return _powers(1 << max(21, int(n + 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; it depends on the slice's bytes alone."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive values of h; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, have, scale = h, 1, _R
    whole, done = None, 0
    while n:  # doubling: a hash of 2k values from two hashes of k values
        if n & 1:
            if whole is None:
                whole = out
            else:
                m = min(len(whole), len(out) - done)
                whole = whole[:m] + out[done : done + m] * U64(pow(_R, done, 1 << 64))
            done += have
        n >>= 1
        if n:
            out = out[:-have] + out[have:] * U64(scale)
            have, scale = have * 2, scale * scale % (1 << 64)
    return mix(whole)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first items (and the total)."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def deal(docs: DataFrame, parts: int, *keys: str | Column) -> DataFrame:
    """docs (without a column _part) as (part, rows): each Arrow batch's rows of a part travel as one compressed block to the part of their keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            part = np.asarray(batch["_part"])
            order = np.argsort(part, kind="stable")
            rows = batch.drop_columns(["_part"]).take(pa.array(order))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]]).tolist() if len(order) else [0]
            blocks = []
            for a, b in zip(edges[:-1], edges[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(rows.slice(a, b - a))
                blocks.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[order][edges[:-1]], pa.int32()), pa.array(blocks, pa.binary())], names=["part", "rows"])

    return docs.withColumn("_part", part_of(parts, *keys)).mapInArrow(pack, "part int, rows binary").repartition(parts, "part")


def undeal(blocks: pa.Table) -> pa.Table:
    """The rows of a part."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks["rows"].to_pylist()]).combine_chunks()
