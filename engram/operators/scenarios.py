"""Scenario clusters of memories in time (AG23) and the best scenario block for a query (RK32)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators.joins import _prefix_pairs, connected, written

#: Rows of a component of which the best are kept before they meet the others'.
SALTS = 64
#: Queries that one scan of the blocks answers.
MAX_QUERIES = 20_000
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def memory_clusters(memories: DataFrame, threshold: float = 0.75, hours: float = 24.0, snippets: int = 3) -> DataFrame:
    """memories (id, project, ts, content) as clusters: project, cluster (its least id), size, earliest, latest, name (from the earliest time), snippets (of the newest),
    place (from 0, newest cluster of the project first).

    Two memories of a project are linked if they are at most `hours` apart and the Jaccard overlap of their words reaches the threshold; a
    cluster is what links connect, alone or not. Pairs meet on a rare word and a time bucket. Memories without a project, id or time are left out; equal times go by id.
    """
    width = int(hours * 3.6e9)
    timed = memories.where("project IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL").select("id", "project", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "content")
    sets = written(timed.select("id", "project", "at", F.transform(tx.word_set(F.lower(F.coalesce("content", F.lit("")))), lambda w: F.xxhash64(w)).alias("w")))
    pairs = _prefix_pairs(sets.withColumn("bucket", F.floor(F.col("at") / width)), threshold, near="bucket")
    a, b = sets.select("id", F.col("w").alias("wa"), F.col("at").alias("ta")), sets.select(F.col("id").alias("id2"), F.col("w").alias("wb"), F.col("at").alias("tb"))
    common = F.size(F.array_intersect("wa", "wb"))
    close = (F.abs(F.col("ta") - F.col("tb")) <= width) & (common >= threshold * (F.size("wa") + F.size("wb") - common) - 1e-9)
    links = pairs.join(a, "id").join(b, "id2").where(close & (common > 0)).select(F.col("id").alias("u"), F.col("id2").alias("v"))
    labels = connected(links).withColumnRenamed("node", "id")
    placed = written(timed.join(labels, "id", "left").select("project", F.coalesce("component", "id").alias("cluster"), "id", "at", F.regexp_replace(F.substring("content", 1, 200), "\n", " ").alias("snippet")))
    facts = placed.groupBy("project", "cluster").agg(F.count("*").alias("size"), F.min("at").alias("first"), F.max("at").alias("last"))
    order = [F.desc("at"), F.asc("id")]
    salted = placed.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["project", "cluster", "_s"], ["project", "cluster"]):  # the newest of each salt, and of those the newest
        salted = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= snippets)
    newest = salted.groupBy("project", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm 'UTC'")
    rows = facts.join(newest, ["project", "cluster"]).withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("last"), "cluster")) - 1)
    return rows.select("project", "cluster", "size", stamp("first").alias("earliest"), stamp("last").alias("latest"), F.concat(F.lit("Scene "), stamp("first")).alias("name"), "snippets", "place")


def scenario_block(name: str = "name", size: str = "size", latest: str = "latest", snippets: str = "snippets"):
    """A cluster as a block: its name, how many memories and when, a line for each snippet."""
    head = F.concat(F.col(name), F.lit("\n\n*"), F.col(size).cast("string"), F.lit(" memories — latest: "), F.col(latest), F.lit("*\n"))
    return F.concat(head, F.array_join(F.transform(snippets, lambda s: F.concat(F.lit("\n- "), s)), ""), F.lit("\n"))


def best_blocks(blocks: DataFrame, queries: DataFrame, words: Column | None = None) -> DataFrame:
    """blocks (project, position, content), queries (query_id, project, text): the block of the query's project that contains most of its distinct words as
    substrings, the first of equals: query_id, position, score. A query without words gets the first block, one of a project without blocks none. words: the distinct
    words of a row of queries, where they aren't the lower-cased text's own.

    The words of a stated query set, MAX_QUERIES at a time, go to the tasks as an automaton; a task reads each block once and keeps the best of each query.
    """
    asked = queries.where("query_id IS NOT NULL AND project IS NOT NULL").select("query_id", "project", (tx.word_set(F.lower(F.coalesce("text", F.lit("")))) if words is None else words).alias("words"))
    asked = written(asked.withColumn("_n", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // MAX_QUERIES))))))
    groups = [r["_n"] for r in asked.select("_n").distinct().orderBy("_n").collect()]
    text = blocks.where("position IS NOT NULL AND project IS NOT NULL").select("project", F.col("position").cast("long").alias("position"), F.lower(F.coalesce("content", F.lit(""))).alias("t"))
    found = None
    for g in groups:
        part = text.mapInArrow(_finder(asked.where(F.col("_n") == g).select("query_id", "project", "words").collect()), "query_id long, position long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return blocks.sparkSession.createDataFrame([], "query_id long, position long, score long")
    best = found.groupBy("query_id").agg(F.max_by(F.struct("position", "score"), F.struct("score", -F.col("position"))).alias("b"))
    return best.select("query_id", "b.position", "b.score")


def _finder(rows: list):
    """Blocks -> each query's best block of a task."""
    queries = [r["query_id"] for r in rows]
    projects: dict[str, list[int]] = {}
    words: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        projects.setdefault(r["project"], []).append(i)
        for w in r["words"]:
            words.setdefault(w, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, askers = ahocorasick.Automaton(), [np.array(own, np.int64) for own in words.values()]
        for k, w in enumerate(words):
            machine.add_word(w, k)
        if words:
            machine.make_automaton()
        mine = {p: np.array(own, np.int64) for p, own in projects.items()}
        best, at = np.full(len(queries), -1, np.int64), np.zeros(len(queries), np.int64)
        for batch in batches:
            for project, position, t in zip(*[batch[c].to_pylist() for c in ("project", "position", "t")]):
                own = mine.get(project)
                if own is None:
                    continue
                hit = {k for _, k in machine.iter(t)} if words else ()
                score = np.bincount(np.concatenate([askers[k] for k in hit]), minlength=len(queries))[own] if hit else np.zeros(len(own), np.int64)
                better = (score > best[own]) | ((score == best[own]) & (position < at[own]))
                best[own[better]], at[own[better]] = score[better], position
        met = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array([queries[i] for i in met], pa.int64()), pa.array(at[met]), pa.array(best[met])], names=["query_id", "position", "score"])

    return run


def block_summaries(blocks: DataFrame, queries: DataFrame, preamble: DataFrame | None = None) -> DataFrame:
    """The best block of each query with its summary: the first line as a title and the four lines after it, stripped; preamble (project, text) stands before it. A
    query of a project without blocks gets the preamble alone, or nothing."""
    best = best_blocks(blocks, queries)
    rows = queries.select("query_id", "project").join(best, "query_id", "left").join(blocks.select("project", "position", "content"), ["project", "position"], "left")
    blank = F.lit(" \t\n\r\x0b\x0c")
    lines = F.split(F.btrim("content", blank), LINE_END)
    title = F.when(F.btrim("content", blank) == "", "Scenario").otherwise(F.btrim(lines[0], blank))
    summary = F.concat(F.lit("## "), title, F.lit("\n"), F.btrim(F.array_join(F.slice(lines, 2, 4), "\n"), blank))
    if preamble is not None:
        rows = rows.join(preamble.select("project", F.col("text").alias("_p")), "project", "left")
        summary = F.when(F.col("_p").isNull(), summary).when(summary.isNull(), F.col("_p")).otherwise(F.concat("_p", F.lit("\n\n"), summary))
    return rows.withColumn("summary", summary).where("summary IS NOT NULL").select("query_id", "project", "position", "score", "summary")
