"""Substring dedup over words: super-k-mer partitioning.

Consecutive 20-word windows that share a minimiser (8 words) travel as one packed string to the
minimiser's bucket, where sorting counts windows exactly; see repeats.py for the passes. Every word
covered by a window that also starts earlier is removed.

Defined results: null and empty texts have no words (dedup_words leaves null texts null); texts of fewer words than a window keep all.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import fresh, table
from engram.llm.repeats import Units, remove_repeats

WORDS = Units(words=True, width=20, gram=8)


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """(words outside the spans, words of the text); bytes.split cuts at the same six ASCII characters."""
    words = text.split()
    if not spans:
        return words, len(words)
    kept, at = [], 0
    for first, last in spans:
        kept += words[at:first]
        at = last
    return kept + words[at:], len(words)


def _digest(text: bytes, spans: list[tuple[int, int]]) -> list:
    kept, n = kept_words(text, spans)
    return [n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()]


def _text(text: bytes, spans: list[tuple[int, int]]) -> list:
    return [b" ".join(kept_words(text, spans)[0]).decode() if spans else text.decode()]


def dedup_words(docs: DataFrame, units: Units = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated words taken out of the text (the rest joined by single spaces; other texts stay as they are)."""
    absent = fresh("absent", docs.columns)
    out = remove_repeats(docs.withColumn(absent, F.col(text_col).isNull()), units, _text, [(text_col, "string", pa.string())], id_col, text_col)
    return out.withColumn(text_col, F.when(~F.col(absent), F.col(text_col))).select(*docs.columns)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without words of repeated 20-word windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = [("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    return remove_repeats(docs, WORDS, _digest, columns)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
