"""Vector search (RK13, RK14, RK20): exact, by locality-sensitive hashing, and by clusters."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, isqrt, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.vectors import cosine
from engram.operators.fusion import top_k
from engram.operators.joins import written


#: Vectors and queries of one matrix product.
SLICE, BLOCK = 8192, 2048
#: Queries whose scores against a slice a task holds at once, and rows of asked files that leave it at once.
CHUNK, ASKED = 128, 16_384


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a list column as a matrix; zero and null ones, and those of another length than the longest, are zero rows."""
    size = pc.max(pc.list_value_length(column)).as_py() or 1
    good = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    m = np.zeros((len(column), size))
    m[np.asarray(good)] = np.asarray(pc.fill_null(pc.list_flatten(column.filter(good)).cast(pa.float64()), 0.0)).reshape(-1, size)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest vectors (id, embedding) of each query (query_id, embedding) of a stated set, the query's own id left out, by cosine: (query_id, id, score, rank).

    keys: columns of both; a query meets vectors of equal keys only. Exact: slices of vectors meet blocks of queries as matrix products, each pair
    in a task of its own, and only a slice's best k of a query leave it. Counts both tables while it is called.
    """
    slices, blocks = 1 + vectors.count() // SLICE, 1 + queries.count() // BLOCK
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    v = vectors.select(*keys, "id", "embedding", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), F.explode(number(blocks)).alias("block"))
    q = queries.select(*[F.col(c).alias(c) for c in keys], F.col("query_id").alias("query_id"), F.col("embedding").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(number(slices)).alias("slice"))

    def best_of(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.round(y @ x.T, 12)
        if not keys:
            score[own[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend, so the smaller one wins ties
        kept = np.take_along_axis(score, best, axis=1)
        row, place = np.nonzero(np.isfinite(kept))
        return own[row], ids[best[row, place]], kept[row, place]

    def products(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(np.asarray(left["id"].combine_chunks()))
            ids, own = np.asarray(left["id"].combine_chunks())[order], np.asarray(right["query_id"].combine_chunks())
            x, y = unit_rows(left["embedding"])[order], unit_rows(right["asked"])
            if x.shape[1] == y.shape[1]:
                found = [best_of(ids, x, own[i : i + CHUNK], y[i : i + CHUNK]) for i in range(0, len(own), CHUNK)]
                out = {n: np.concatenate([f[j] for f in found]) for j, n in enumerate(out)}
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in out.items()})

    met = v.groupBy(*keys, "slice", "block").cogroup(q.groupBy(*keys, "slice", "block")).applyInArrow(products, "query_id long, id long, score double")
    return top_k(met, k)


def nearest_in_pool(pool: DataFrame) -> DataFrame:
    """(query_id, id, nearest): the best similarity to another row of the query's pool."""
    other = pool.select("query_id", F.col("id").alias("_id"), F.col("embedding").alias("_e"))
    both = pool.select("query_id", "id", "embedding").join(other, "query_id").where("id <> _id")
    return both.groupBy("query_id", "id").agg(F.max(cosine(F.col("embedding"), F.col("_e"))).alias("nearest"))


#: Random directions of a sketch, in 64-bit words; a bucket is named by the first bits of the first word.
SKETCH_WORDS = 8
#: Rows that share a bucket on average, and buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 1024, 4096
#: Buckets' and sketches' distances may lie so many standard deviations above what a neighbour's would be on average.
PROBE_SIGMAS, SKETCH_SIGMAS = 3.0, 1.6
#: k-means is fitted on at most so many vectors a cluster; the clusters grow with the square root of the rows up to MAX_CLUSTERS.
FIT_ROWS, MAX_CLUSTERS = 64, 4096
#: Rows of a bucket or cluster that one task takes, and queries that it answers.
FILE_ROWS, FILE_QUERIES = 8192, 4096


def _directions(size: int) -> np.ndarray:
    """64 * SKETCH_WORDS directions, orthonormal within each block of `size`; the same in every run."""
    rng = np.random.default_rng(20240117)
    blocks = [np.linalg.qr(rng.normal(size=(size, size)))[0].T for _ in range(-(-64 * SKETCH_WORDS // size))]
    return np.concatenate(blocks)[: 64 * SKETCH_WORDS]


def _sketches(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(projections, their signs as words) of unit rows."""
    p = unit @ _directions(unit.shape[1]).T
    return p, np.packbits(p > 0, axis=1, bitorder="little").view(np.uint64)


def _width(vectors: DataFrame) -> int:
    """The longest vector's length."""
    return vectors.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0


def _rows(table: pa.Table | pa.RecordBatch, column: str, size: int) -> np.ndarray:
    """unit_rows of a column, with zero rows for those of another length than size."""
    c = table[column]
    c = c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c])
    usable = pc.fill_null(pc.equal(pc.list_value_length(c), size), False)
    m = np.zeros((len(c), size))
    if pc.any(usable).as_py():
        m[np.asarray(usable)] = unit_rows(c.filter(usable))
    return m


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)[: len(values) + 1]), pa.array(values.ravel(), kind))


def _files(vectors: DataFrame, asks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """vectors (name, id, ...) and asks (name, query_id, ...) with part and side, so that a large file and much asked ones are dealt over several tasks. Files are MAX_BUCKETS at most."""
    sizes = vectors.groupBy(name).agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("parts"))
    cut = F.broadcast(sizes.join(asks.groupBy(name).agg(F.ceil(F.count("*") / FILE_QUERIES).cast("int").alias("sides")), name))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    posted = vectors.join(cut, name).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("side", every("sides")).drop("parts", "sides")
    asked = asks.join(cut, name).withColumn("side", F.pmod(F.xxhash64("query_id"), "sides").cast("int")).withColumn("part", every("parts")).drop("parts", "sides")
    return posted, asked


HITS = "query_id long, id long, score double, met long"


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, the smaller id first among equals."""
    score = np.round(score, 12)
    if len(ids) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _allowed(acls: list, principals: list) -> np.ndarray:
    """Which rows any of the principals may see; a row without an ACL is seen by none."""
    own = set(principals)
    return np.array([bool(a) and not own.isdisjoint(a) for a in acls], bool)


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int, exact: bool = False, counted: bool = False) -> DataFrame:
    """The k nearest vectors (id, embedding) of each query (query_id, embedding) but the query's own id, by query-directed multi-probe hashing: query_id, id, score
    (cosine in [0, 1]), rank.

    A vector's sketch is the signs of its projections on fixed directions, and the first bits name its bucket. A query first looks into the buckets that are
    cheapest to reach (flipping the bits nearest to a border) and scores what lies closest by sketch; the k-th score found is what a
    neighbour has at least, and says how far off its bucket and its sketch may be. All buckets and sketches within that reach (PROBE_SIGMAS, SKETCH_SIGMAS
    standard deviations beyond the mean) are then met and scored. exact: no reach, everything is scored.

    Where vectors have a column `acl` and queries `principals`, postings that share no principal with the query are passed over before anything is scored: a null
    or empty ACL is seen by no one, a query without principals sees nothing. Zero and null vectors and those of another length
    than the longest take no part. counted: with the number of vectors that each query scored, as `met`.
    """
    n, size = vectors.count(), _width(vectors)
    if size < 1:  # nothing to find
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int" + (", met long" if counted else ""))
    bits = max(0, min(MAX_BUCKETS.bit_length() - 1, round(np.log2(max(1, n / BUCKET_ROWS)))))
    guarded = "acl" in vectors.columns and "principals" in queries.columns
    extra, asker = (["acl"], ["principals"]) if guarded else ([], [])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _rows(b, "embedding", size)
            keep = np.flatnonzero(unit.any(axis=1))
            if len(keep):
                _, words = _sketches(unit[keep])
                b = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array((words[:, 0] & np.uint64((1 << bits) - 1)).astype(np.int32)), b["id"], _listed(unit[keep], pa.float64()), _listed(words.view(np.int64), pa.int64()), *[b[c] for c in extra]], names=["bucket", "id", "unit", "words", *extra])

    schema = f"bucket int, id long, unit array<double>, words array<long>{', acl array<string>' if guarded else ''}"
    posted = written(vectors.select(F.col("id").cast("long").alias("id"), "embedding", *extra).where("id IS NOT NULL").mapInArrow(index, schema))
    count = {r["bucket"]: r["n"] for r in posted.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # MAX_BUCKETS rows at most
    names = np.array(sorted(count), np.int64)
    held = np.array([count[b] for b in names.tolist()], np.int64)
    first_rows = max(4 * BUCKET_ROWS, n // 16)

    def costs(projections: np.ndarray) -> np.ndarray:
        """What reaching each bucket costs a query: the border distances of the bits that differ."""
        differ = ((names[:, None] >> np.arange(bits)) & 1) != (projections[:bits] > 0)
        return differ @ np.abs(projections[:bits])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets that a query looks into: at first the cheapest with first_rows rows, later (with `least`, the k-th score) all others within reach."""
        for b in batches:
            unit = _rows(b, "embedding", size)
            p, words = _sketches(unit)
            again = "least" in b.schema.names
            places, files, reach = [], [], []
            for i in range(len(unit)):
                if not unit[i].any() or not len(names):
                    continue
                cost = costs(p[i])
                order = np.argsort(cost, kind="stable")
                before = int(np.searchsorted(np.cumsum(held[order]), first_rows)) + 1
                most = 64.0 * SKETCH_WORDS
                if not again:
                    chosen = order[:before]
                else:
                    s = b["least"][i].as_py()
                    chosen = np.arange(len(names))
                    if not exact and s is not None:
                        s = min(max(s, 0.0), 0.999999)
                        off = np.array([0.5 * erfc(x) for x in np.abs(p[i][:bits]) * s / sqrt(2 * (1 - s * s) / size)])  # that a neighbour's bit differs
                        far = np.abs(p[i][:bits])
                        chosen = np.flatnonzero(cost <= (far * off).sum() + PROBE_SIGMAS * sqrt((far * far * off * (1 - off)).sum()) + 1e-9)
                        share = np.arccos(s) / np.pi
                        most = most * share + SKETCH_SIGMAS * sqrt(most * share * (1 - share))
                places += [i] * len(chosen)
                files += names[chosen].tolist()
                reach += [most] * len(chosen)
            taken = b.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), taken["query_id"], _listed(unit[places], pa.float64()), _listed(words[places].view(np.int64), pa.int64()), pa.array(reach, pa.float64()), *[taken[c] for c in asker]], names=["bucket", "query_id", "unit", "words", "reach", *asker])

    def search(best_only: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                ids, x = np.asarray(left["id"].combine_chunks()), matrix_of(left["unit"])
                words = matrix_of(left["words"]).view(np.uint64)
                acls = left["acl"].to_pylist() if guarded else None
                masks: dict[tuple, np.ndarray] = {}
                asked = zip(right["query_id"].to_pylist(), matrix_of(right["unit"]), matrix_of(right["words"]).view(np.uint64), right["reach"].to_pylist(), right["principals"].to_pylist() if guarded else [None] * right.num_rows)
                for q, y, w, most, who in asked:
                    seen = ids != q
                    if guarded:
                        who = tuple(sorted(set(who or ())))
                        if who not in masks:
                            masks[who] = _allowed(acls, who)
                        seen = seen & masks[who]
                    far = np.bitwise_count(words ^ w).sum(axis=1)
                    met = np.flatnonzero(seen & (far <= most))
                    if best_only and len(met) > 3 * k:
                        met = met[np.argpartition(far[met], 3 * k)[: 3 * k]]
                    score = x[met] @ y
                    top = met[_best(ids[met], score, k)]
                    out += [(q, i, s, None) for i, s in zip(ids[top].tolist(), np.round(x[top] @ y, 12).tolist())] + [(q, None, None, len(met))]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "id", "score", "met"])

        return run

    def visit(asks: DataFrame, best_only: bool) -> DataFrame:
        left, right = _files(posted, asks, "bucket")
        key = ["bucket", "part", "side"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search(best_only), HITS)

    kind = f"bucket int, query_id long, unit array<double>, words array<long>, reach double{', principals array<string>' if guarded else ''}"
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding", *asker).where("query_id IS NOT NULL")
    found = written(visit(asked.mapInArrow(ask, kind), True))
    once = lambda df: df.where("id IS NOT NULL").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    pairs = top_k(once(found), k)
    least = pairs.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = written(visit(asked.join(least, "query_id", "left").mapInArrow(ask, kind), False))
    hits = once(found.unionByName(more)).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    out = top_k(hits, k)
    if not counted:
        return out
    return out.join(found.unionByName(more).groupBy("query_id").agg(F.sum("met").alias("met")), "query_id", "left")


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    c = column.combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    return np.asarray(c.flatten()).reshape(len(c), -1)


def fit_centres(vectors: DataFrame, clusters: int) -> np.ndarray:
    """Unit centres of k-means by cosine, from the FIT_ROWS * clusters vectors of least id hash."""
    some = vectors.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS * clusters)
    units = Normalizer(inputCol="_v", outputCol="unit").transform(some.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>"))))
    model = KMeans(k=clusters, featuresCol="unit", distanceMeasure="cosine", seed=1, maxIter=10).fit(units)
    m = np.array([c.tolist() for c in model.clusterCenters()])
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def cluster_search(vectors: DataFrame, queries: DataFrame, k: int, clusters: int | None = None, visits: int = 4) -> DataFrame:
    """The k nearest vectors of each query by cosine, exact, by branch and bound over k-means clusters: query_id, id, score, rank.

    A query first looks into its `visits` nearest clusters. No vector of a cluster is nearer than the angle to its centre less the cluster's
    radius (its widest angle), so only clusters whose bound reaches the k-th score found are looked into then. Clusters grow with the
    square root of the rows. Zero and null vectors and those of another length than the longest take no part.
    """
    n, size = vectors.count(), _width(vectors)
    usable = vectors.where((F.size("embedding") == size) & F.exists("embedding", lambda x: x != 0) & F.col("id").isNotNull())
    centres = fit_centres(usable, max(2, clusters or min(MAX_CLUSTERS, isqrt(n)))) if size and not usable.isEmpty() else np.zeros((1, max(1, size)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _rows(b, "embedding", size)
                near = unit @ centres.T
                own = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b["id"], _listed(unit, pa.float64()), pa.array(angle)], names=["cluster", "id", "unit", "angle"])

    posted = written(usable.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(index, "cluster int, id long, unit array<double>, angle double"))
    radius = {r["cluster"]: r["r"] for r in posted.groupBy("cluster").agg(F.max("angle").alias("r")).collect()}  # MAX_CLUSTERS rows at most
    names = np.array(sorted(radius), np.int64)
    wide = np.array([radius[c] for c in names.tolist()])

    def asked_of(b: pa.RecordBatch, unit: np.ndarray, places: list, files: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), b.take(pa.array(places, pa.int64()))["query_id"], _listed(unit[places], pa.float64())], names=["cluster", "query_id", "unit"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows leave as soon as ASKED of them are there: a query may ask every cluster."""
        for b in batches:
            unit = _rows(b, "embedding", size)
            again = "least" in b.schema.names
            places, files = [], []
            for i in np.flatnonzero(unit.any(axis=1)).tolist() if len(names) else []:
                near = centres[names] @ unit[i]
                order = np.argsort(-near, kind="stable")
                chosen = order[:visits]
                if again:
                    s = b["least"][i].as_py()
                    rest = order[visits:]
                    bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near[rest], -1, 1)) - wide[rest]))
                    chosen = rest if s is None else rest[bound >= s - 1e-9]
                places += [i] * len(chosen)
                files += names[chosen].tolist()
                if len(places) >= ASKED:
                    yield asked_of(b, unit, places, files)
                    places, files = [], []
            yield asked_of(b, unit, places, files)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x, y = np.asarray(left["id"].combine_chunks()), matrix_of(left["unit"]), matrix_of(right["unit"])
            asking = right["query_id"].to_pylist()
            for start in range(0, len(asking), CHUNK):
                for q, score in zip(asking[start : start + CHUNK], np.round(y[start : start + CHUNK] @ x.T, 12)):
                    met = np.flatnonzero(ids != q)
                    top = met[_best(ids[met], score[met], k)]
                    out += [(q, i, s) for i, s in zip(ids[top].tolist(), score[top].tolist())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    def visit(asks: DataFrame) -> DataFrame:
        left, right = _files(posted, asks, "cluster")
        key = ["cluster", "part", "side"]
        return left.drop("angle").groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, id long, score double")

    kind = "cluster int, query_id long, unit array<double>"
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("query_id IS NOT NULL")
    found = written(visit(asked.mapInArrow(ask, kind)))
    once = lambda df: df.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    least = top_k(once(found), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = visit(asked.join(least, "query_id", "left").mapInArrow(ask, kind))
    return top_k(once(found.unionByName(more)), k)
