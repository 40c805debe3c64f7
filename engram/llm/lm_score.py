"""Stupid-backoff scores of documents against the n-gram counts of all other documents.

The corpus is dealt into parts by document id. A part explodes its texts into 1- to 3-grams (64-bit
hashes), counts the distinct ones and sends them, sorted and delta-packed, to hash buckets. A bucket is
one partition of the count tables: it sums the counts of a gram over all parts and answers each part in the
order in which it asked. The part joins the answers to its n-grams and sums each document's log scores.
A frequent gram is one entry for each part, whatever its count.

A document's own occurrences are taken out of the counts it is scored with. With c(.) the counts that are left,
a word scores c(w1 w2 w3) / c(w1 w2) if the trigram is left, else 0.4 * c(w2 w3) / c(w2), else
0.4 * 0.4 * max(c(w3), 1) / N, with N the words of the corpus; the first two words of a text start at their own order.

Defined results: null texts and texts without words score null; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import ALNUM, LOWER, U64, buffers, deal, gram_hashes, group_count, mix, row_chunks, rows_of, slice_hashes, table, text_bytes, undeal, words

ORDER = 3
ALPHA = 0.4
PART_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20


def pack(values: np.ndarray) -> bytes:
    """A compact form of ascending 64-bit values: differences, one byte plane after the other."""
    delta = np.diff(values, prepend=U64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def pack_counts(values: np.ndarray) -> bytes:
    """64-bit counts, one byte plane after the other; the high planes are zeros nearly everywhere."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def word_codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row) of a part."""
    codes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in row_chunks(*buffers(rows["text"])):
        low = LOWER[data]
        starts, ends, bounds = words(low, offsets, ALNUM)
        codes.append(slice_hashes(low, starts, ends))
        counts.append(np.diff(bounds))
    return np.concatenate(codes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def grams(codes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, last word) of each n-gram that lies in one row."""
    h = mix(gram_hashes(codes, n) + U64(n))
    inside = np.repeat(bounds[1:], np.diff(bounds))[: len(h)] - np.arange(len(h)) >= n
    return h[inside], np.flatnonzero(inside) + n - 1


def distinct_grams(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to ORDER: (distinct hashes, counts, number of each n-gram, last word of each n-gram)."""
    out = []
    for n in range(1, ORDER + 1):
        h, last = grams(codes, bounds, n)
        distinct, number, count = np.unique(h, return_inverse=True, return_counts=True)
        out.append((distinct, count, number, last))
    return out


def cuts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts among ascending hashes; buckets are ranges of hashes."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def _ask(buckets: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        out = []
        for n, (h, count, _, _) in enumerate(distinct_grams(*word_codes(undeal(rows))), 1):
            at = cuts(h, buckets).tolist()
            out += [(b, part, n, pack(h[i:j]), pack_counts(count[i:j])) for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
        cols = list(zip(*out)) or [()] * 5
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("bucket", "part", "n", "grams", "counts"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    return run


def _answer(rows: pa.Table) -> pa.Table:
    n = np.asarray(rows["n"].combine_chunks())
    parts, bucket = rows["part"].to_pylist(), rows["bucket"].to_pylist()
    asked, counts = rows["grams"].to_pylist(), rows["counts"].to_pylist()
    made: list[tuple] = []
    for order in range(1, ORDER + 1):
        which = np.flatnonzero(n == order).tolist()
        if not which:
            continue
        hs = [unpack(asked[i]) for i in which]
        _, name = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(name, weights=np.concatenate([unpack_counts(counts[i]) for i in which]))[name]
        at = 0
        for i, h in zip(which, hs):
            made.append((parts[i], bucket[i], order, pack_counts(total[at : at + len(h)])))
            at += len(h)
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("part", "bucket", "n", "totals"), zip(*made), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))})


def _score(total_words: int) -> Callable:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = undeal(blocks)
        codes, bounds = word_codes(rows)
        doc = rows_of(bounds)
        size = len(codes)
        left = np.zeros((ORDER + 1, size), np.int64)  # by order and last word: the count without the document's own
        found: dict[int, list[tuple[int, bytes]]] = {}
        for n, b, raw in zip(answers["n"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist()):
            found.setdefault(n, []).append((b, raw))
        for n, (distinct, _, number, last) in enumerate(distinct_grams(codes, bounds), 1):
            if not len(distinct):
                continue
            total = np.concatenate([unpack_counts(raw) for _, raw in sorted(found[n], key=lambda x: x[0])])
            own, inverse = np.unique(doc[last] * len(distinct) + number, return_inverse=True)
            own = np.bincount(inverse)[inverse]
            left[n, last] = total[number] - own
        before = np.concatenate([np.zeros((ORDER + 1, 1), np.int64), left[:, :-1]], axis=1)  # the context's count ends a word earlier
        place = np.arange(size) - bounds[doc] if size else np.zeros(0, np.int64)
        tri = left[3] > 0
        bi = ~tri & (left[2] > 0)
        p = np.maximum(left[1], 1) / max(total_words, 1) * ALPHA ** np.minimum(place, ORDER - 1)
        p[bi] = left[2][bi] / before[1][bi] * ALPHA ** (np.minimum(place[bi], ORDER - 1) - 1)
        p[tri] = left[3][tri] / before[2][tri]
        count = lambda x: np.bincount(doc, weights=x, minlength=len(bounds) - 1)
        n_words = np.diff(bounds)
        score = count(np.log(p)) / np.maximum(n_words, 1)
        kept = {n: rows[n] for n in rows.column_names if n != "text"}
        return pa.table(kept | {"n_words": pa.array(n_words), "n_trigram": pa.array(count(tri).astype(np.int64)), "n_bigram": pa.array(count(bi).astype(np.int64)), "score": pa.array(score, mask=n_words == 0)})

    return run


def count_words(docs: DataFrame, text_col: str = "text") -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for _, _, data, offsets in row_chunks(*buffers(batch["t"])):
                n += len(words(LOWER[data], offsets, ALNUM)[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return int(docs.select(F.col(text_col).alias("t")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])


ADDED = ("n_words", "n_trigram", "n_bigram", "score")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_trigram and n_bigram (words scored at that order) and score (mean log score of a word).

    Columns of these names are replaced; others may have any names. Counts the corpus's words while it is called.
    """
    total = text_bytes(docs, text_col)
    parts, buckets = group_count(total, PART_BYTES), group_count(total, BUCKET_BYTES)
    rest = [c for c in docs.columns if c not in (text_col, *ADDED)]
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col(text_col).alias("text"))
    by_part = deal(own, parts, f"c{rest.index(id_col)}", F.xxhash64("text")).groupBy("part")
    asked = by_part.applyInArrow(_ask(buckets), "bucket int, part int, n int, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "part int, bucket int, n int, totals binary")
    schema = own.drop("text").select("*", *[F.lit(0).cast("long").alias(c) for c in ADDED[:3]], F.lit(None).cast("double").alias("score")).schema
    out = by_part.cogroup(answers.groupBy("part")).applyInArrow(_score(count_words(docs, text_col)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *ADDED)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean stupid-backoff score of every document against all other documents."""
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("score", F.round("score", 6))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, p, w[p] AS w1, CASE WHEN p > 1 THEN w[p - 1] || ' ' || w[p] END AS w2, CASE WHEN p > 2 THEN w[p - 2] || ' ' || w[p - 1] || ' ' || w[p] END AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
c AS (SELECT doc_id, p,
  count(w1) OVER (PARTITION BY w1) - count(w1) OVER (PARTITION BY w1, doc_id) AS c1,
  CASE WHEN w2 IS NULL THEN 0 ELSE count(w2) OVER (PARTITION BY w2) - count(w2) OVER (PARTITION BY w2, doc_id) END AS c2,
  CASE WHEN w3 IS NULL THEN 0 ELSE count(w3) OVER (PARTITION BY w3) - count(w3) OVER (PARTITION BY w3, doc_id) END AS c3 FROM e),
b AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, c3 > 0 AS tri, c3 = 0 AND c2 > 0 AS bi, CASE WHEN c3 > 0 THEN c3 / b2 WHEN c2 > 0 THEN c2 / b1 * pow(0.4, least(p - 1, 2) - 1) ELSE greatest(c1, 1) / (SELECT count(*) FROM e) * pow(0.4, least(p - 1, 2)) END AS x FROM b)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(t, 0) AS n_trigram, coalesce(u, 0) AS n_bigram, round(v, 6) AS score
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (tri) AS t, count(*) FILTER (bi) AS u, avg(ln(x)) AS v FROM s GROUP BY doc_id) USING (doc_id)
"""
