"""Suffix-array dedup over bytes: prefix doubling over content-sampled positions.

A suffix array of all bytes costs a row for each byte in every round, about ten times the input on
disk. Any 100-byte string holds a minimiser, a position chosen by the string's own content, so it is
enough to rank those positions (one in about thirty): Spark deals their names (36 bytes) to buckets, which
rank them and drop what is unique, and only windows around survivors go on to the next round, where names
of 100 bytes are made from pairs of names at growing offsets, sorted and compared; see repeats.py. Every byte
covered by a 100-byte string that also starts earlier is removed.

Defined results: null texts are empty (dedup_bytes leaves them null); texts shorter than the threshold keep all bytes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import fresh, table
from engram.llm.repeats import Units, remove_repeats

BYTES = Units(words=False, width=100, gram=36)


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    out, at = [], 0
    for first, last in spans:
        out.append(text[at:first])
        at = last
    return b"".join([*out, text[at:]])


def _digest(text: bytes, spans: list[tuple[int, int]]) -> list:
    kept = kept_bytes(text, spans)
    return [len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters that they cut."""
    out = []
    for first, last in spans:
        while first < last and text[first] & 0xC0 == 0x80:
            first += 1
        while last > first and last < len(text) and text[last] & 0xC0 == 0x80:
            last -= 1
        if first < last:
            out.append((first, last))
    return out


def _text(text: bytes, spans: list[tuple[int, int]]) -> list:
    return [kept_bytes(text, whole_characters(text, spans)).decode()]


def dedup_bytes(docs: DataFrame, units: Units = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated strings taken out of the text; characters that a span's edge would cut stay."""
    absent = fresh("absent", docs.columns)
    out = remove_repeats(docs.withColumn(absent, F.col(text_col).isNull()), units, _text, [(text_col, "string", pa.string())], id_col, text_col)
    return out.withColumn(text_col, F.when(~F.col(absent), F.col(text_col))).select(*docs.columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes of repeated 100-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    return remove_repeats(docs, BYTES, _digest, columns)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS t FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM later)) GROUP BY doc_id, g),
gaps AS (SELECT r.doc_id, a, b, lag(b, 1, 0) OVER o AS prev FROM run r WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
cuts AS (SELECT d.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || any_value(substr(h, 2 * m + 1)) AS k, count(*) AS n, sum(b - a) AS gone
         FROM d JOIN (SELECT *, max(b) OVER (PARTITION BY doc_id) AS m FROM gaps) USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id)
"""
