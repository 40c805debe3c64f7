"""Whitening of integer vectors by the exact characteristic polynomial of their scatter.

Spark sums the products of the distinct vectors exactly, so that n * sum(x x') - S S', which is n * n times the covariance, is known as
a matrix of integers. Its characteristic polynomial is computed modulo as many 31-bit primes as bound its coefficients (tasks
share the primes; each reduces the matrix to Hessenberg form and unrolls the recurrence of its leading minors), and Chinese
remaindering gives the integer coefficients. All roots are real and none negative, so the sign changes of the polynomial's
coefficients, shifted to t, are exactly the number of roots above t (Budan, Fourier): bisection with exact shifts encloses
the largest eigenvalues to a relative width of 2**-PRECISION. Inverse iteration on the integer matrix at those values,
in decimal arithmetic of DIGITS digits, gives the null spaces: components right to the last bit of a double, however close eigenvalues lie.

Only statistics of d * d numbers reach the driver (d: the vectors' length, as a rule below a few hundred); vectors are projected in tasks.

Defined results: vectors that are null or hold null or non-finite entries are dropped, so are those of another length than the commonest
(the shorter one in a tie). Repeated rows and equal vectors are all answered, but count once in every covariance; a row without an id is answered
with a null id. Components of eigenvalue zero can't be scaled and are left out: fewer than `count` if the rank is lower, none for fewer than
two distinct vectors or an empty table. Eigenvalues equal to a relative 2**-EQUAL share a space, of which an orthonormal basis is given. A
deviation that passes 64 bits is null; an entry that passes LIMIT as a whole number is an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Context, Decimal, localcontext
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.ann import matrix
from engram.llm.common import table, written

PRECISION = 110
EQUAL = 60
DIGITS = 100
#: Larger whole numbers are an error: sums of products would not fit 38 digits.
LIMIT = 1 << 40
#: Primes that a task takes at once.
PRIMES_EACH = 8


def _whole(c: Column) -> Column:
    """The floor of a double, as a double without a negative zero."""
    fits = F.when(F.abs(c) < float(LIMIT), F.floor(c)).otherwise(F.raise_error(F.lit(f"an entry passes {LIMIT}")).cast("bigint"))
    return fits.cast("double")


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and x (whole numbers, as doubles) of the vectors that take part."""
    v = F.col(vec_col)
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    out = vectors.where(F.coalesce(good, F.lit(False)) & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: _whole(c.cast("double") * scale)).alias("x"))
    sizes = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return out.where(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's [rows, sums, upper triangle of the sum of products], exact."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch["x"])
        size = max(1, int(np.abs(x).max()))
        rows = min(len(x), (1 << 53) // (size * size))  # so many products add up exactly in doubles
        for a in range(0, len(x), max(1, rows)):
            part = x[a : a + max(1, rows)]
            whole = [[int(c) for c in row] for row in part.tolist()] if not rows else part
            products = np.array(whole, object).T @ np.array(whole, object) if not rows else (part.T @ part).astype(np.int64).astype(object)
            sums = [sum(map(int, c)) for c in part.T.tolist()]
            now = np.array([len(part), *sums, *products[np.triu_indices(x.shape[1])]], object)
            total = now if total is None else total + now
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.decimal128(38, 0)))], names=["values"])


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums S, n * sum(x x') - S S') of the rows of column x, exact integers."""
    rows = fit.select("x").mapInArrow(_products, "values array<decimal(38,0)>").select(F.posexplode("values").alias("place", "value"))
    values = [int(r["value"]) for r in sorted(rows.groupBy("place").agg(F.sum("value").alias("value")).collect())]
    if not values:
        return 0, [], []
    d = (isqrt(8 * len(values) + 1) - 3) // 2  # 1 + d + d * (d + 1) / 2 values
    n, s, upper = values[0], values[1 : d + 1], iter(values[d + 1 :])
    out = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            out[i][j] = out[j][i] = n * next(upper) - s[i] * s[j]
    return n, s, out


def is_prime(n: int) -> bool:
    """Right for every odd n from 9 to 2**32 (bases 2, 7 and 61)."""
    r = ((n - 1) & (1 - n)).bit_length() - 1
    for base in (2, 7, 61):
        x = pow(base, (n - 1) >> r, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, from the largest, whose product passes bound."""
    out, product, p = [], 1, (1 << 31) + 1
    while product <= bound:
        p -= 2
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to a modulo p, without entries below the first subdiagonal."""
    h = a.copy()
    for m in range(1, len(h) - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if pivot := int(below[0]):
            h[[m, m + pivot]] = h[[m + pivot, m]]
            h[:, [m, m + pivot]] = h[:, [m + pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """det(t - a) modulo p: coefficients from that of 1 to that of t**d."""
    h, d = hessenberg(a, p), len(a)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        factors, below = np.zeros(k, np.int64), 1
        factors[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            factors[i] = int(h[i, k - 1]) * below % p
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (factors[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """det(t - a) of an integer matrix without negative eigenvalues: exact coefficients, from that of 1 to that of t**d."""
    d = len(a)
    # a coefficient is a sum of products of eigenvalues, at most (1 + mean eigenvalue) ** d altogether
    primes = primes_beyond(2 * (2 + sum(a[i][i] for i in range(d)) // d) ** d)
    shared = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["p"].to_pylist()
            found = [polynomial_mod(np.array([[x % p for x in row] for row in shared.value], np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([batch["p"], pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES_EACH))
    rows = dealt.mapInArrow(run, "p long, c array<long>").collect()  # so many primes as log2(bound) / 31
    whole, coefficients = 1, [0] * (d + 1)
    for r in rows:
        p = r["p"]
        inverse = pow(whole, -1, p)
        coefficients = [c + whole * ((x - c) * inverse % p) for c, x in zip(coefficients, r["c"])]
        whole *= p
    return [c - whole if 2 * c > whole else c for c in coefficients]


def sign_changes(q: list[int]) -> int:
    signs = [c > 0 for c in q if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def shifted(q: list[int]) -> list[int]:
    """q(t + 1)."""
    q = q[:]
    for i in range(len(q) - 1):
        for j in range(len(q) - 2, i - 1, -1):
            q[j] += q[j + 1]
    return q


def largest_roots(q: list[int], count: int) -> list[Decimal]:
    """The `count` largest positive roots, with repetitions, of a polynomial whose roots are real and not negative; to a relative 2**-PRECISION."""
    d = len(q) - 1
    bits = max(1, (abs(q[d - 1]) + 1).bit_length())  # the sum of the roots is below 2**bits
    top = [c << (bits * i) for i, c in enumerate(q)]  # roots below 1
    out: list[Decimal] = []
    context = Context(prec=DIGITS)
    for k in range(1, min(count, sign_changes(q)) + 1):
        now, low, halvings = top, 0, 0  # the k-th root is in (low, low + 1] in units of 2**(bits - halvings)
        while low >> PRECISION == 0:
            now = [c << (d - i) for i, c in enumerate(now)]  # twice as large roots
            upper = shifted(now)
            halvings, low = halvings + 1, 2 * low
            if sign_changes(upper) >= k:
                now, low = upper, low + 1
        out.append(context.multiply(Decimal(2 * low + 1), context.power(Decimal(2), bits - halvings - 1)))
    return out


def solver(a: list[list[int]], shift: Decimal) -> Callable[[list[Decimal]], list[Decimal]]:
    """v -> the solution y of (a - shift) y = v, by elimination with row pivots; a zero pivot counts as a tiny one."""
    d = len(a)
    rows = [[Decimal(x) - shift if i == j else Decimal(x) for j, x in enumerate(row)] for i, row in enumerate(a)]
    tiny = max(abs(x) for row in rows for x in row) * Decimal(10) ** (5 - DIGITS)
    places = list(range(d))
    for m in range(d):
        pivot = max(range(m, d), key=lambda i: abs(rows[i][m]))
        rows[m], rows[pivot], places[m], places[pivot] = rows[pivot], rows[m], places[pivot], places[m]
        head = rows[m]
        if abs(head[m]) < tiny:
            head[m] = tiny
        for row in rows[m + 1 :]:
            u = row[m] = row[m] / head[m]
            if u:
                row[m + 1 :] = [x - u * y for x, y in zip(row[m + 1 :], head[m + 1 :])]

    def solve(v: list[Decimal]) -> list[Decimal]:
        y = [v[i] for i in places]
        for i in range(d):
            y[i] -= sum((x * z for x, z in zip(rows[i][:i], y)), Decimal(0))
        for i in range(d - 1, -1, -1):
            y[i] = (y[i] - sum((x * z for x, z in zip(rows[i][i + 1 :], y[i + 1 :])), Decimal(0))) / rows[i][i]
        return y

    return solve


def components(a: list[list[int]], roots: list[Decimal]) -> list[list[float]]:
    """A unit vector of the null space of a - root for each root, orthogonal to those before."""
    dot = lambda x, y: sum((p * q for p, q in zip(x, y)), Decimal(0))
    found: list[list[Decimal]] = []
    with localcontext(Context(prec=DIGITS)):
        off = 1 + Decimal(2) ** (4 - PRECISION)  # a shift beside the root, so that no solution passes DIGITS
        for k, root in enumerate(roots):
            solve = solver(a, root * off)
            v = [Decimal((i * 7919 + (k + 1) * 104729) % 1009 + 1) for i in range(len(a))]
            for _ in range(5):
                v = solve(v)
                for u in found * 2:  # twice: what rounding leaves goes too
                    along = dot(u, v)
                    v = [y - along * x for x, y in zip(u, v)]
                norm = dot(v, v).sqrt()
                v = [x / norm for x in v]
            found.append(v)
    return [[float(x) for x in v] for v in found]


def whiten(vectors: DataFrame, count: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, component, n, deviation, whitened, explained and identity_error for each usable vector and component.

    Jobs run while it is called: the distinct vectors are written, their products summed, and the projections' covariance measured.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vec_col, scale)
    fit = written(base.select("x").distinct(), "whitening-fit")
    n, sums, a = scatter(fit)
    schema = f"`{id_col}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    trace = sum(a[i][i] for i in range(len(a)))
    if not trace:
        return spark.createDataFrame([], schema)
    roots = largest_roots(characteristic_polynomial(spark, a), count)
    basis = np.array(components(a, roots)).T
    wide = [float(root) for root in roots]
    scales = np.array([float(root.sqrt(Context(prec=DIGITS))) for root in roots])  # n times the deviation along a component
    explained = [w / trace for w in wide]
    m = len(roots)

    def centred(x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n * x - S, as doubles, and the sums of its squares."""
        size = n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums))
        if size * size * len(sums) < 1 << 63:
            y = x.astype(np.int64) * n - np.array(sums, np.int64)
            return y.astype(np.float64), (y * y).sum(axis=1).tolist()
        rows = [[n * int(c) - s for c, s in zip(row, sums)] for row in x.tolist()]
        squares = [sum(c * c for c in row) for row in rows]
        return np.array([[float(c) for c in row] for row in rows]).reshape(x.shape), [q if q < 1 << 63 else None for q in squares]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, squares = centred(matrix(batch["x"]))
                w = (y @ basis) / scales  # (x - S / n) . v / sqrt(e), as e = root / n**2
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, m, dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(squares, pa.int64()), whitened], names=["id", "deviation", "w"])

    measured = fit.select(F.lit(None).cast("long").alias("id"), "x").mapInArrow(project, "id bigint, deviation bigint, w array<double>")
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    covariance = measured.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(covariance[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    rows = base.mapInArrow(project, "id bigint, deviation bigint, w array<double>").select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    shares = F.element_at(F.array(*[F.lit(x) for x in explained]), F.col("k") + 1)
    return rows.select(F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings along the first four components."""
    return whiten(table(spark, sf_dir, "embeddings"))
