"""Extension points (UD1-UD7): embedding providers, chunkers, parsers, rerankers, alert sinks, ACL resolvers and custom aggregates."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions import text as tx
from engram.sources import notes

Embed = Callable[[list[str]], list[list[float]]]


def embedder(embed: Embed) -> Callable[[Column], Column]:
    """UD1: a Column function from a batch embedding function; it is called once a batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(embed(b.fillna("").tolist()), index=b.index)

    return run


def hashing_embedding(size: int = 64) -> Embed:
    """The default provider: signed word hashes, unit length; no model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(size, np.float32)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h >> 31 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


#: UD2: a strategy is a Column function from text to an array of chunks.
CHUNKERS: dict[str, Callable[[Column], Column]] = {"fixed": tx.fixed_chunks, "sentence": lambda t: tx.sentence_chunks(t, 4000), "paragraph": lambda t: notes.paragraph_chunks(t, 2000)}
#: UD3: a parser is a DataFrame function from (conversation, json) to messages.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = dict(notes.PARSERS)


def chunk(docs: DataFrame, strategy: str, text: str = "text") -> DataFrame:
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(CHUNKERS[strategy](F.col(text))).alias("i", "chunk"))


def rerank_with(pool: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """UD4: score(query texts, candidate texts) for pool (query_id, id, rank, query, content); unscored rows follow in their order."""
    from engram.operators.fusion import rerank

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return score(q, c)

    return rerank(pool, pool.select("query_id", "id", run("query", "content").alias("ext")), k)


def parse(rows: DataFrame, provider: str) -> DataFrame:
    """UD3: rows (conversation, json) by the registered parser of a provider, layout or MIME type."""
    return PARSERS[provider.lower()](rows)


def alert_sink(callback: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """UD5: a foreachBatch function that hands a batch's alerts to a callback as a DataFrame, so a callback that writes or posts by partition loses none."""

    def batch(alerts: DataFrame, batch_id: int) -> None:
        callback(alerts)

    return batch


def with_acl(hits: DataFrame, acls: DataFrame, ids: list[str]) -> DataFrame:
    """UD6: hits whose ACL, by id, lets one of the principals in; an id without an ACL row is denied."""
    from engram.operators.filters import acl_closed

    return hits.join(acls.select("id", "acl_allow"), "id").where(acl_closed(F.col("acl_allow"), ids)).drop("acl_allow")


def acl_intersection(acls: Column) -> Column:
    """UD7: the members of all arrays of an array; null members count as empty, no arrays give null."""
    clean = F.transform(acls, lambda a: F.coalesce(a, F.array().cast("array<string>")))
    return F.when(F.size(clean) > 0, F.array_sort(F.reduce(clean, F.array_distinct(clean[0]), lambda a, b: F.array_intersect(a, b))))
