"""A training corpus from raw documents: five stages, each by one of the numbered operators.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import bpe, decontaminate, langid, near_dups, suffix_dedup
from engram.llm.common import fresh, table, with_checkpoints


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language can be told: texts that are null, empty or have no letter go, all others stay as they are.

    The model is the one of op5, learnt from the labelled documents of the stage's own input; without any labelled
    document no language can be told and all go. Repeated rows and rows without an id are judged one by one; an
    empty table stays empty; other columns, whatever their names, are kept.
    """
    names = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    judged = langid.predict(docs, langid.fit_documents(docs), langid.piece_path(), names=names)
    return judged.where(F.col(names[0]) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of least doc_id; all its rows stay as they are.

    Rows without an id or text stay. Rows that share an id stay or go together, judged by the least of their
    texts. An empty table stays empty; other columns, whatever their names, are kept.
    """
    return near_dups.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without strings of 100 bytes or more that also start earlier; n_chars, where docs have it, counts what is left.

    No row goes; null texts stay null with their n_chars, a text may end up empty. Repeated rows (one id and text) are
    edited alike. An empty table stays empty; other columns, whatever their names, are kept.
    """
    out = suffix_dedup.dedup_bytes(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without contaminated ones (a hit, and at least one word in twenty hit); all others stay as they are.

    Null and empty texts hold no words and stay; every row is judged by itself, so repeated rows go or stay
    together. An empty table stays empty, an empty benchmark removes nothing; other columns, whatever their names, are kept.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left.

    One row for each row of docs; null and empty texts have no ids. An empty table gives an empty one.
    """
    import public_tokenizers

    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_items", benchmark_items),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents table."""
    with_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Language identification can't be written as SQL.
ORACLE_SQL = None
