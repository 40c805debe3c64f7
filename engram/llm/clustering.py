"""Centroid clustering of integer vectors with subvector dictionaries.

The vectors' dimensions are cut into blocks. A task turns each chunk of its vectors into, for every block, a dictionary of
the chunk's distinct subvectors and a code for each vector: nothing is lost, and the chunks are written once. A round
computes the exact squared distance of every dictionary entry to every centroid's block, once, and a vector's distance is
the sum of its codes' entries; the sums of a cluster are the entries weighted by how often the cluster holds their code.
Only the centroids (k rows of integers) go to the tasks and only k sums come back, added up by Spark before the driver
sees them. Nothing is shuffled but those sums, so copies of one vector, however many, load no key.

Defined results: a component c counts as floor(scale * c); vectors that are null, of another length, or hold null or
non-finite components take no part. Components whose integer passes 2**27 in size are an error, as squared distances would not
fit 64 bits. Equal ids are separate vectors; a vector without an id is assigned like any other but starts no centroid, and
vectors of equal start hash are ordered by their components. Fewer than k vectors start as many centroids; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.ann import matrix
from engram.llm.common import table, written

CHUNK_ROWS = 1 << 15
#: Dimensions of a block: two keep a dictionary to a few thousand entries on components of one byte.
BLOCK = 2
LIMIT = 1 << 27
CHUNKS = "ids array<bigint>, codes array<binary>, entries array<binary>"


class Chunk(NamedTuple):
    """Some vectors: for each block, every vector's code, and the distinct subvectors by code."""

    codes: list[np.ndarray]
    entries: list[np.ndarray]


def to_chunk(x: np.ndarray, block: int) -> Chunk:
    codes, entries = [], []
    for d in range(0, x.shape[1], block):
        part = x[:, d : d + block]
        code = np.zeros(len(x), np.int64)
        for column in part.T:  # pairs of (code so far, value's own code) are numbered again after each dimension
            values, own = np.unique(column, return_inverse=True)
            code = np.unique(code * len(values) + own, return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1]
        codes.append(code.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32))
        entries.append(np.ascontiguousarray(part[first]))
    return Chunk(codes, entries)


def distances(chunk: Chunk, centroids: np.ndarray, block: int) -> np.ndarray:
    """Squared distances of a chunk's vectors to the centroids: the entries' partial distances, summed by code."""
    out = np.zeros((len(chunk.codes[0]), len(centroids)), np.int64)
    for b, (codes, entries) in enumerate(zip(chunk.codes, chunk.entries)):
        gap = entries[:, None, :] - centroids[None, :, b * block : b * block + entries.shape[1]]
        out += (gap * gap).sum(axis=2)[codes]
    return out


def cluster_sums(chunk: Chunk, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors."""
    sums = []
    for codes, entries in zip(chunk.codes, chunk.entries):
        held = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
        sums.append(held @ entries)
    return np.concatenate(sums, axis=1)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """id and v (doubles) of the vectors that take part."""
    v = F.col(vec_col)
    good = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(v * scale)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component times {scale} passes {LIMIT}: squared distances would not fit 64 bits")
    return x.astype(np.int64)


def encode(vectors: DataFrame, scale: int, block: int) -> DataFrame:
    """Chunks of the vectors of usable()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            chunk = to_chunk(integers(matrix(rows["v"].combine_chunks()), scale), block)
            lists = [pa.array([[np.ascontiguousarray(a).tobytes() for a in part]], pa.list_(pa.binary())) for part in (chunk.codes, chunk.entries)]
            return pa.RecordBatch.from_arrays([pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())), *lists], names=["ids", "codes", "entries"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                yield flush()
                held.clear()
        if sum(b.num_rows for b in held):
            yield flush()

    return vectors.mapInArrow(run, CHUNKS)


def chunks_of(batches: Iterator[pa.RecordBatch], dims: int, block: int) -> Iterator[tuple[pa.Array, Chunk]]:
    """(ids, chunk) of each encoded row."""
    widths = [min(block, dims - d) for d in range(0, dims, block)]
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch["ids"][i].values
            entries = [np.frombuffer(e.as_buffer(), np.int64).reshape(-1, w) for e, w in zip(batch["entries"][i], widths)]
            codes = [np.frombuffer(c.as_buffer(), np.uint16 if len(e) <= 1 << 16 else np.uint32) for c, e in zip(batch["codes"][i], entries)]
            yield ids, Chunk(codes, entries)


def _tally(centroids: np.ndarray, block: int) -> Callable:
    """One row for each cluster that a task met: its number of vectors, inertia and sums."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, chunk in chunks_of(batches, dims, block):
            distance = distances(chunk, centroids, block)
            cluster = distance.argmin(axis=1)  # the first of equal ones
            nearest = distance[np.arange(len(cluster)), cluster]
            n += np.bincount(cluster, minlength=k)
            for c in range(k):
                own = nearest[cluster == c]
                inertia[c] += (int((own >> 32).sum()) << 32) + int((own & 0xFFFFFFFF).sum())
            sums += cluster_sums(chunk, cluster, k)
        met = np.flatnonzero(n).tolist()
        values = pa.array([[int(n[c]), inertia[c], *sums[c].tolist()] for c in met], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), values], names=["cluster", "values"])

    return run


def tally(chunks: DataFrame, centroids: np.ndarray, block: int) -> dict[int, list[int]]:
    """{cluster: [vectors, inertia, sums...]} of the clusters that have vectors, exact."""
    rows = chunks.mapInArrow(_tally(centroids, block), "cluster int, values array<decimal(38,0)>")
    total = rows.select("cluster", F.posexplode("values").alias("place", "value")).groupBy("cluster", "place").agg(F.sum("value").alias("value"))
    out: dict[int, list[int]] = {}
    for r in sorted(total.collect()):  # at most k * (dims + 2) rows
        out.setdefault(r["cluster"], []).append(int(r["value"]))
    return out


def start_centroids(vectors: DataFrame, k: int, scale: int, dims: int) -> np.ndarray:
    """The k vectors of least hash, as integers."""
    named = vectors.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"), "v")
    rows = named.orderBy("h", "v").limit(k).collect()
    return integers(np.array([r["v"] for r in rows], np.float64).reshape(-1, dims), scale)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each usable vector.

    Jobs run while it is called: the encoding, `rounds` rounds and the final tally. k * dims is what travels to each task.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vec_col, dims)
    chunks = written(encode(kept, scale, block), "vector-chunks")
    centroids = start_centroids(kept, k, scale, dims)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, _, *sums) in tally(chunks, centroids, block).items():
            centroids[c] = [s // n for s in sums]
    found = tally(chunks, centroids, block) if len(centroids) else {}
    total = sum(x[1] for x in found.values())
    facts = [(c, x[1], total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in found.items()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in chunks_of(batches, dims, block):
            distance = distances(chunk, centroids, block)
            nearest = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(distance[np.arange(len(nearest)), nearest])], names=[id_col, "cluster", "distance"])

    out = chunks.where(F.lit(bool(facts))).mapInArrow(assign, f"`{id_col}` bigint, cluster int, distance bigint")
    by_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(by_cluster), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings in 16 clusters after three rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 3) -> str:
    """The same rounds in DuckDB: every vector against every centroid, componentwise floors of integer sums."""
    parts = [
        """x AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)""",
        """c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM x WHERE vec_id IS NOT NULL QUALIFY c < 16)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT i, arg_min(c, d * 16 + c) AS c, CAST(min(d) AS BIGINT) AS d FROM (
  SELECT x.i, k.c, list_sum(list_transform(range(1, 65), lambda j: (x.v[j] - k.v[j]) * (x.v[j] - k.v[j]))) AS d FROM x, c{r} k) GROUP BY i)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT c, list(f ORDER BY j) AS v FROM (SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
  SELECT a.c, j, sum(x.v[j]) AS s, count(*) AS n FROM a{r} a JOIN x USING (i), range(1, 65) t(j) GROUP BY a.c, j)) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{r} k LEFT JOIN m{r} m USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT x.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM x JOIN a{rounds} a USING (i) JOIN c{rounds} k ON k.c = a.c"""


OP11_SQL = _sql()
