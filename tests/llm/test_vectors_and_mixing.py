"""Clustering, whitening and mixing against brute force on small tables with every hard case, and on the driver's tables."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from engram.llm import clustering, mixing, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, id string, x int, cluster string, component int, n string, distance double"
EXTRA = ("i", 1, "c", 2, "n", 0.5)


def vector_rows(dims, n=120):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=dims) * 0.2).tolist(), *EXTRA) for i in range(n)]
    rows += [(n + i, rows[7][1], *EXTRA) for i in range(60)]  # a third are copies of one vector
    rows += [rows[3], (None, rows[5][1], *EXTRA), (None, [0.0] * dims, *[None] * 6), (900, [-0.0] * dims, *EXTRA)]
    rows += [(901, None, *EXTRA), (902, [], *EXTRA), (903, [None] + [0.1] * (dims - 1), *EXTRA), (904, [float("nan")] * dims, *EXTRA), (905, [float("-inf")] * dims, *EXTRA), (906, [1.0] * (dims + 1), *EXTRA)]
    return rows


def brute_clusters(rows, dims, k, rounds):
    kept = [(i, [int(np.floor(64 * c)) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        for j, vs in own.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize("dims,block,k", [(8, 2, 5), (7, 3, 4), (8, 1, 300)])
def test_clusters_equal_brute_force(spark, monkeypatch, dims, block, k):
    monkeypatch.setattr(clustering, "CHUNK_ROWS", 37)
    rows = vector_rows(dims)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted(map(tuple, clustering.cluster(df, k, 3, dims=dims, block=block).collect()), key=repr)
    assert got == brute_clusters(rows, dims, k, 3)


def test_clusters_of_nothing_and_of_few(spark):
    df = spark.createDataFrame(vector_rows(8), VECTORS)
    assert clustering.cluster(df, dims=64).count() == 0
    assert clustering.cluster(df.where("false"), dims=8).count() == 0
    assert clustering.cluster(df.where("vec_id IS NULL"), dims=8).count() == 0
    few = clustering.cluster(df.where("vec_id < 2"), dims=8).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(0, 0), (1, 0)]
    with pytest.raises(Exception, match="would not fit"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<double>"), dims=8).count()


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-30, 30, (500, 9))
    for block in (1, 2, 4, 9):
        chunk = clustering.to_chunk(x, block)
        assert (np.concatenate([e[c] for c, e in zip(chunk.codes, chunk.entries)], axis=1) == x).all()
        centroids = rng.integers(-30, 30, (4, 9))
        assert (clustering.distances(chunk, centroids, block) == ((x[:, None] - centroids) ** 2).sum(axis=2)).all()
        own = rng.integers(0, 4, 500)
        assert (clustering.cluster_sums(chunk, own, 4) == np.array([x[own == c].sum(axis=0) for c in range(4)])).all()


def test_cluster_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, clustering.op11_clusters(spark, SF).collect())) == sorted(con.execute(clustering.OP11_SQL).fetchall())


def check_whitening(rows, vectors, scale=256, count=4):
    """Contract of the result against numpy on the distinct whole vectors."""
    x = {i: np.floor(scale * np.array(v, float)) + 0.0 for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, basis = np.linalg.eigh(v)
    e, basis = e[::-1], basis[:, ::-1]
    rank = int((e > e[0] * 1e-9).sum())
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-9
    assert set(got) == set(x) and all(sorted(g) == list(range(1, min(count, rank) + 1)) for g in got.values())
    for k in range(min(count, rank)):
        mine = np.array([got[i][k + 1]["whitened"] for i in x])
        want = np.array([(y - s / n) @ basis[:, k] / np.sqrt(e[k]) for y in x.values()])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert all(abs(g[k + 1]["explained"] - e[k] / np.trace(v)) < 1e-9 for g in got.values())
    for i, y in x.items():
        assert got[i][1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(y, s))


def test_whitening_equals_numpy(spark):
    rows = [r for r in vector_rows(8) if r[0] is not None and r[0] < 900]
    hard = [r for r in vector_rows(8) if r[0] is None or r[0] > 900]
    df = spark.createDataFrame(rows + [r for r in hard if r[0] is not None], VECTORS).repartition(3)
    found = [r for r in whitening.whiten(df).collect()]
    repeated = {r[0] for r in rows}
    assert len(found) == 4 * len(rows)  # a repeated row is answered each time
    check_whitening(found, {i: v for i, v, *_ in rows if i in repeated})
    assert whitening.whiten(spark.createDataFrame(hard[:2] + rows, VECTORS)).where("vec_id IS NULL").count() == 8


def test_whitening_of_low_rank(spark):
    line = [(i, [i / 8.0, i / 4.0, 0.0]) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in found} == {1} and all(r["explained"] == pytest.approx(1) for r in found)
    for rows in ([], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_equal_eigenvalues(spark):
    """A cross polytope: all eigenvalues are equal, any orthonormal basis will do."""
    rows = [(2 * i + s, [(1.0 - 2 * s) * (i == j) for j in range(5)]) for i in range(5) for s in (0, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 40 and all(r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(0.2) for r in found)


def test_whitening_of_large_numbers(spark):
    """Products beyond doubles and deviations beyond 64 bits."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 1e7).tolist()) for i in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["identity_error"] < 1e-9 for r in found) and any(r["deviation"] is None for r in found)
    x = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for r in found:
        want = sum((40 * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (want if want < 1 << 63 else None)


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(4)
    b = rng.integers(-9, 9, (7, 5)).astype(object)
    for a in ((b @ b.T).tolist(), [[0] * 3] * 3, [[5]], [[2, 0], [0, 2]]):
        d = len(a)
        want, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]  # the traces of powers give the coefficients
        for k in range(1, d + 1):
            m = [[sum(a[i][j] * m[j][c] for j in range(d)) + (want[-1] if i == c else 0) for c in range(d)] for i in range(d)]
            want.append(-sum(sum(a[i][j] * m[j][i] for j in range(d)) for i in range(d)) / k)
        assert whitening.characteristic_polynomial(spark, a) == [int(c) for c in want[::-1]]


def test_close_roots_are_told_apart():
    from decimal import Decimal

    big = 10**15
    q = [1]
    for root in (big, big - 1, big - 1, 3, 0):
        q = [a - root * b for a, b in zip([0, *q], [*q, 0])]
    roots = whitening.largest_roots(q, 6)
    assert len(roots) == 4 and all(abs(r / w - 1) < Decimal(2) ** -100 for r, w in zip(roots, (big, big - 1, big - 1, 3)))


def test_whitening_query(spark):
    rows = whitening.op12_whitening(spark, SF).collect()
    check_whitening(rows, {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()})


DOCS = "doc_id long, text string, source string, size string, key int, part string, h int, `row` string, copies string"


def mix_rows():
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 120))), f"s{i % 5}") for i in range(150)]
    rows += [(200 + i, "a  b\tc\n d " * 5, "s0") for i in range(90)]  # a third are copies
    rows += [(300, "long " * 9000, "s1"), (301, "x " * 500, "tiny"), (302, "", "s2"), (303, None, "s3"), (304, " \n ", "blank"), (305, "one two", None), (306, "é ü 　z", "Ω"), (307, "q", "")]
    rows += [(None, "no id", "s4"), rows[3], (3, "another text of three", "s3")]
    return [(*r, "z", 1, "p", 2, "r", "k") for r in rows]


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), {n for n in names if not sizes[n]}
    while True:
        level = Fraction(total - sum(3 * sizes[n] for n in capped), sum(weight[n] for n in names if n not in capped))
        more = {n for n in names if n not in capped and weight[n] * level > 3 * sizes[n]}
        if not more:
            return {n: 3 * sizes[n] if n in capped else float(weight[n] * level) for n in names}
        capped |= more


def check_mix(rows, docs, source_of):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for text, source in docs:
        sizes[source] += size(text)
    want = brute_targets(sizes)
    for r in rows:
        s = source_of(r)
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-12, abs=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
    for r in rows:  # no copy more or less of any document would bring its source nearer
        gap = round(want[source_of(r)]) - taken[source_of(r)]
        if r["size"] and (r["copies"] < 3 if gap > 0 else r["copies"] > 0):
            assert r["size"] >= 2 * abs(gap), r


def test_mix_meets_targets(spark, monkeypatch):
    rows = mix_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "source", "key", "part", "h", "row", "size", "source_size", "target", "copies", "taken"}
    check_mix(got, [r[1:3] for r in rows], lambda r: r["source"])
    assert {(r["key"], r["part"], r["h"], r["row"]) for r in got} == {(1, "p", 2, "r")}
    monkeypatch.setattr(mixing, "PART_ROWS", 10)  # large classes in several parts
    parts = mixing.mix(df.repartition(3), keep=("doc_id", "text", "source")).collect()
    check_mix(parts, [r[1:3] for r in rows], lambda r: r["source"])
    mixed = mixing.repeated(spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "doc_id long, copies int"))
    assert sorted(map(tuple, mixed.collect())) == [(2, 1, 1), (3, 3, 1), (3, 3, 2), (3, 3, 3)]


def test_rates_are_tilted_by_size(spark):
    """Entropy balancing: within a source the logarithm of an uncapped rate is in proportion to size."""
    df = spark.createDataFrame([("=a", 1, 500), ("=a", 10, 400), ("=a", 100, 30), ("=b", 5, 100), ("=b", 50, 100)], "key string, size long, docs long")
    shares = spark.createDataFrame([("=a", "a", 7500, 930, 2500.0, False), ("=b", "b", 5500, 200, 9000.0, False)], "key string, source string, size long, docs long, target double, full boolean")
    solved = {r["key"]: r for r in mixing.solve(df, shares, 3).collect()}
    for key, rows in (("=a", [(1, 500), (10, 400), (100, 30)]), ("=b", [(5, 100), (50, 100)])):
        r = solved[key]
        assert sum(n * s * min(3.0, np.exp(r["dual"] * s / r["mean"])) for s, n in rows) == pytest.approx(r["target"], rel=1e-8)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame(mix_rows(), DOCS)
    assert mixing.mix(df.where("false")).count() == 0
    blank = mixing.mix(df.where("text IS NULL OR source = 'blank'")).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in blank} == {(0, 0, 0.0)}


def test_mix_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = mixing.op13_mixing(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    check_mix(rows, [(r["text"], r["source"]) for r in docs.values()], lambda r: docs[r["doc_id"]]["source"])
    assert sorted(rows) == sorted(mixing.op13_mixing(spark, SF).collect())

