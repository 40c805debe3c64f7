"""Approximate nearest neighbours by a permutation index.

A bounded sample of distinct vectors serves as pivots. Every vector is represented by its PREFIX nearest
pivots in order and posted in the inverted files of the first POSTS of them; a query visits the files of its
own nearest pivots (64, or a fourteenth of all if that is more; the same rule at every size). In a file, postings are ranked by the footrule distance of their pivot orders to the
query's, the best RERANK_SHARE of them (RERANK at least) are reranked by the exact inner product, and the best k of all files win.

A file of more than FILE_ROWS postings, or asked by more than FILE_QUERIES queries, is dealt over several tasks (the numbers of
postings and of queries of each pivot are tables of at most MAX_PIVOTS rows), so one vector may make up any share of the
rows. Queries that met fewer than k vectors visit all files. The pivots grow with the square root of the rows up to MAX_PIVOTS, and so does the
work of a query; every row is indexed. `exact`: all files are visited and all postings reranked.

Defined results: vectors that are null, zero or hold null or non-finite components, vectors without an id and those of
another length than the commonest take no part; rows with one id count as one vector, that of best score; ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import table

MAX_PIVOTS = 4096
PREFIX = 16
POSTS = 8
#: A query visits the files of one pivot in VISIT_SHARE, and of LEAST_VISITS at least.
VISIT_SHARE = 14
LEAST_VISITS = 64
#: Of a file part's postings, those of least footrule distance are reranked: this share, RERANK at least.
RERANK_SHARE = 0.9
RERANK = 1000
FILE_ROWS = 4096
FILE_QUERIES = 2048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of the vectors that take part."""
    v = F.col(vec_col)
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    out = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    sizes = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return out.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """At most n distinct directions, from the 4n rows of least id hash."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(4 * n).select("v").collect()
    m = np.array([r["v"] for r in rows], np.float64)
    if not len(m):
        return m
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    _, first = np.unique(np.round(m, 9), axis=0, return_index=True)
    return m[np.sort(first)][:n]


def matrix(column: pa.Array) -> np.ndarray:
    """A fixed-length list column as a matrix."""
    n = len(column)
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def _orders(pivots, prefix: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = matrix(batch["v"]) @ p.T
            keep = min(prefix, near.shape[1])
            order = np.argsort(-near, axis=1, kind="stable")[:, :keep].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, keep, dtype=np.int32)), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], lists], names=["id", "v", "pivots"])

    return run


def _search(k: int, prefix: int, share: float) -> Callable:
    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if posted.num_rows and asked.num_rows:
            ids, v, near = np.asarray(posted["id"].combine_chunks()), matrix(posted["v"].combine_chunks()), matrix(posted["pivots"].combine_chunks()).astype(np.int64)
            place = np.full((int(near.max()) + 1, len(ids)), prefix, np.int16)  # of each pivot in each posting's order
            place[near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])] = np.tile(np.arange(near.shape[1]), len(ids))
            order = np.argsort(ids, kind="stable")
            rerank = max(RERANK, ceil(share * len(ids)))
            qids, qv, qnear = np.asarray(asked["id"].combine_chunks()), matrix(asked["v"].combine_chunks()), matrix(asked["pivots"].combine_chunks()).astype(np.int64)
            for q, x, pivots in zip(qids.tolist(), qv, qnear):
                rank = np.flatnonzero(pivots < len(place))
                footrule = np.abs(place[pivots[rank]] - rank[:, None].astype(np.int16)).sum(axis=0)
                best = order[np.argsort(footrule[order], kind="stable")[: rerank + 1]]
                best = best[ids[best] != q][:rerank]
                score = (v[best] * x).sum(axis=1)
                top = np.lexsort((ids[best], -score))[:k]
                out.append((np.full(len(top), q), ids[best[top]], score[top]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """For each query row (same columns as vectors): query_id, rank, vec_id and score of the k best vectors found but itself.

    Jobs run while it is called: the vectors are counted, the pivots chosen, and it is asked whether any query met fewer than k.
    """
    base = usable(vectors, id_col, vec_col)
    n = base.count()
    spark = vectors.sparkSession
    pivots = choose_pivots(base, min(MAX_PIVOTS, max(16, 4 * isqrt(n))))
    m = max(1, len(pivots))
    shared = spark.sparkContext.broadcast(pivots)
    visits = m if exact else min(m, max(LEAST_VISITS, m // VISIT_SHARE))
    schema = base.select("id", "v", F.array().cast("array<int>").alias("pivots")).schema
    indexed = base.mapInArrow(_orders(shared, PREFIX), schema)
    files = indexed.withColumn("file", F.explode(F.slice("pivots", 1, POSTS)))
    sizes = files.groupBy("file").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("parts"))
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id"]).mapInArrow(_orders(shared, max(PREFIX, visits)), schema)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def visit(asking: DataFrame, depth: int) -> DataFrame:
        asks = asking.withColumn("file", F.explode(F.slice("pivots", 1, depth)))
        cut = sizes.join(asks.groupBy("file").agg(F.ceil(F.count("*") / FILE_QUERIES).cast("int").alias("sides")), "file")
        posted = files.join(F.broadcast(cut), "file").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("side", every("sides"))
        asks = asks.join(F.broadcast(cut), "file").withColumn("side", F.pmod(F.xxhash64("id"), "sides").cast("int")).withColumn("part", every("parts"))
        asks = asks.select("file", "part", "side", "id", "v", F.slice("pivots", 1, PREFIX).alias("pivots"))
        met = posted.select("file", "part", "side", "id", "v", "pivots").groupBy("file", "part", "side").cogroup(asks.groupBy("file", "part", "side"))
        return met.applyInArrow(_search(k, PREFIX, 1.0 if exact else RERANK_SHARE), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = visit(asked, visits)
    top = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    enough = top.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = usable(queries, id_col, vec_col).dropDuplicates(["id"]).join(enough, "id", "left_anti")
    if visits < m and short.limit(1).count():
        more = visit(short.mapInArrow(_orders(shared, m), schema), m).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
        top = top.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return top.select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
