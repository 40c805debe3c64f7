"""Payload decoding (TX27) and name folding (AG17): the only text functions that need Python."""

from __future__ import annotations

import base64
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.operators.filters import is_secret_path

MOST_BYTES = 1 << 20


@F.pandas_udf(T.StringType())
def gunzip_base64(payload: pd.Series) -> pd.Series:
    """The text of a base64 gzip payload; null if it is malformed, not UTF-8, or larger than MOST_BYTES."""

    def one(p: str | None) -> str | None:
        if p is None:
            return None
        try:
            d = zlib.decompressobj(31)
            raw = d.decompress(base64.b64decode(p, validate=True), MOST_BYTES + 1)
            return raw.decode() if d.eof and len(raw) <= MOST_BYTES else None
        except (ValueError, zlib.error):
            return None

    return payload.map(one)


@F.pandas_udf(T.StringType())
def fold_name(name: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case, without blanks, dashes and underscores."""

    def one(n: str | None) -> str | None:
        if n is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c))
        return "".join(c for c in plain.lower() if c not in " \t\n_-")

    return name.map(one)


def file_diffs(checkpoints: DataFrame, projects: list[str] | None) -> DataFrame:
    """checkpoints (checkpoint_id, project_slug, created_at, diffs: map of path to payload): readable diffs of the projects, without secret paths, in time order."""
    rows = checkpoints if projects is None else checkpoints.where(F.col("project_slug").isin(projects))
    each = rows.select("checkpoint_id", "created_at", F.explode("diffs").alias("path", "payload")).where(~is_secret_path(F.col("path")))
    return each.withColumn("diff", gunzip_base64("payload")).where("diff IS NOT NULL").drop("payload").orderBy("created_at", "path")


def state_digest(rows: DataFrame, fmt: str, order: str, *columns: str | Column) -> DataFrame:
    """One text of a line for each row, in order (small state tables: one row a key of a report)."""
    line = F.struct(order, F.format_string(fmt, *columns).alias("line"))
    return rows.select(line.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("digest"))
