"""Lexical recall (RK1-RK12, RK28-RK32): BM25 for many queries over a corpus of any size, and what is built on it.

Statistics are always those of the whole corpus; masks and filters restrict what is scored. Postings meet
query terms in an equi-join on the term, so queries never meet documents that share no term with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.functions.vectors import cosine
from engram.operators import filters as fl
from engram.operators.fusion import minmax, parallel_gates, ranked, rerank, top_k
from engram.operators.vector import nearest_in_pool

K1, B = 1.5, 0.75
#: Rows (query, term) that are broadcast at most; the number is checked.
QUERY_TERMS = 500_000
#: Pairs of a query and a document that a task sums at most, about, if all of them meet.
TASK_PAIRS = 1_000_000
#: Parts of an entry's blocks where more query terms are shuffled.
SALTS = 64
#: Weights of where a block comes from. Fixed values.
SOURCE_WEIGHTS = {"memory": 1.0, "rule": 0.95, "discovery": 0.85, "session": 0.70}


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), tx.tokenize(text).alias("tok"), tx.token_count(text).alias("n_tok"))


def parts(docs: DataFrame, queries: DataFrame, key: str) -> int:
    """How many parts docs are dealt into for all queries, so that no task holds the sums of more than TASK_PAIRS pairs. Counts both."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, 1 + docs.count() * queries.select(key).distinct().count() // TASK_PAIRS)


def postings(tok: DataFrame, terms: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """(id, term, tf, dl), of the given terms only; one exchange, by id (into `dealt` parts), that later groupings by id and more columns share."""
    rows = tok.select("id", F.size("tok").alias("dl"), F.explode_outer("tok").alias("term")).where("term IS NOT NULL")  # not explode: its inferred filter would tokenise twice
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    rows = rows.repartition("id") if dealt is None else rows.repartition(dealt, "id")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_statistics(tok: DataFrame) -> DataFrame:
    """One row: n and avgdl."""
    return tok.agg(F.count("*").alias("n"), F.avg("n_tok").alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qn): a repeated term counts as often as it occurs."""
    tok = tokens(queries, id_col, text_col)
    return tok.select(F.col("id").alias("query_id"), F.explode_outer("tok").alias("term")).where("term IS NOT NULL").groupBy("query_id", "term").agg(F.count("*").alias("qn"))


def bm25(tok: DataFrame, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of all pairs that share a term. allowed: ids that may be scored; statistics stay global. Counts documents, queries and query terms while it is called."""
    post = postings(tok, terms, parts(tok, terms, "query_id"))
    df = post.groupBy("term").agg(F.count_if(F.col("tf") <= F.col("dl")).alias("df"))  # always true; both branches read the same columns, so the exchange is reused
    if allowed is not None:
        post = post.join(allowed, "id", "left_semi")
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    stats = F.broadcast(corpus_statistics(tok))  # one row
    few = terms.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS  # then postings stay where they are, dealt by id
    weighted = terms.join(df, "term").crossJoin(stats).select("query_id", "term", (F.col("qn") * idf).alias("w"), "avgdl")
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if few:
        weighted = F.broadcast(weighted)
    return post.join(weighted, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * gain).alias("score"))


def field_boost(scores: DataFrame, terms: DataFrame, fields: DataFrame, boost: float = 1.2) -> DataFrame:
    """fields: (id, term) of facts and concepts; a score is boosted when any query term is among the document's."""
    hit = terms.select("query_id", "term").distinct().join(fields.distinct(), "term").select("query_id", "id", F.lit(True).alias("_hit")).distinct()
    both = scores.join(hit, ["query_id", "id"], "left")
    return both.withColumn("score", F.when(F.col("_hit"), F.col("score") * boost).otherwise(F.col("score"))).drop("_hit")


def source_weight(source: Column) -> Column:
    out = None
    for name, w in SOURCE_WEIGHTS.items():
        out = (F if out is None else out).when(source == name, w)
    return out.otherwise(1.0)


def hits_boost(hits: Column) -> Column:
    return F.least(1.0 + 0.1 * F.coalesce(hits, F.lit(0)), F.lit(1.5))


def recall_factors(blocks: DataFrame) -> DataFrame:
    """blocks (id, source, project, content, recency_rank, hits) with the query-independent factors of the composite score."""
    f = F.col("source_weight") / (1 + F.col("recency_rank") * 0.01) * F.col("boilerplate_penalty") * F.col("lexical_richness") * F.col("query_hits_boost")
    parts = {"source_weight": source_weight(F.col("source")), "boilerplate_penalty": tx.boilerplate(F.col("content")), "lexical_richness": tx.richness(F.col("content")), "query_hits_boost": hits_boost(F.col("hits"))}
    return blocks.withColumns(parts).withColumn("factor", f)


FACTORS = ("source_weight", "boilerplate_penalty", "lexical_richness", "query_hits_boost")


def composite_recall(scores: DataFrame, blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Score x factor, doubled where the query names the block's project (four characters or more); with the factors and the raw score."""
    rows = scores.join(recall_factors(blocks).select("id", "file", "source", "project", *FACTORS, "factor"), "id").join(queries.select("query_id", "text"), "query_id")
    named = (F.length("project") >= 4) & F.contains(F.lower("text"), F.lower("project"))
    boost = F.when(F.coalesce(named, F.lit(False)), 2.0).otherwise(1.0)
    rows = rows.withColumn("bm25_score", F.col("score")).withColumn("mention_boost", boost)
    return rows.withColumn("score", F.col("score") * F.col("factor") * F.col("mention_boost")).drop("text", "factor")


def best_per_file(scores: DataFrame) -> DataFrame:
    """The best block of each file and query, scores above 0 only, rounded to four places."""
    w = Window.partitionBy("query_id", "file").orderBy(F.round("score", 9).desc(), "id")
    return scores.where("score > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("score", F.round("score", 4))


def in_scope(blocks: DataFrame, project: str | None, others: tuple[str, ...], room: str | None, ambient: bool) -> DataFrame:
    """The blocks that may be recalled: no ambient traces unless asked for; of the project (or the others, or none) and room, where these are given."""
    if "type" in blocks.columns and not ambient:
        blocks = blocks.where(fl.not_ambient(F.col("type")))
    if project is not None:
        blocks = blocks.where(fl.in_project(F.col("project"), project, others))
        if room is not None:
            blocks = blocks.where(fl.in_room(F.col("sub_scope"), room))
    return blocks


def recall(
    blocks: DataFrame, queries: DataFrame, k: int, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, blend: str = "rrf", gates: bool = False, external: DataFrame | None = None,
    project: str | None = None, others: tuple[str, ...] = (), room: str | None = None, ambient: bool = False, pool: int = 50, snippet: int = 1500,
) -> DataFrame:
    """Recall end to end for many queries: scope filters, BM25 over what is in scope, field boost (where blocks have `fields`), composite factors, best
    block of each file, vector stage, gates, rerank, top k.

    blocks: id, file, source, project, content, recency_rank, hits and, where used, type, sub_scope, fields. vectors: id, embedding; query_vectors: query_id, embedding;
    external: query_id, id, ext, or id, ext for all queries. `pool` is how many files a query's later stages look at. Returns query_id, id, source, score, snippet, rank (from 0), the
    explain columns and engaged_layers.
    """
    kept = in_scope(blocks, project, others, room, ambient)
    terms = query_terms(queries, "query_id", "text")
    scores = bm25(tokens(kept, "id", "content"), terms)
    if "fields" in kept.columns:
        scores = field_boost(scores, terms, kept.select("id", F.explode(F.flatten(F.transform("fields", tx.tokenize))).alias("term")))
    found = top_k(best_per_file(composite_recall(scores, kept, queries)), pool)
    layers = ["bm25"]
    if vectors is not None and query_vectors is not None:
        found = vector_stage(found, vectors, query_vectors, max(2 * k, 10), blend)
        layers.append("embedding")
        if gates:
            near = nearest_in_pool(found.where("embedding IS NOT NULL"))
            found = parallel_gates(found.join(near, ["query_id", "id"], "left").withColumns({"cosine": F.coalesce("cosine", F.lit(0.0)), "nearest": F.coalesce("nearest", F.lit(0.0))}))
            layers.append("fusion_gates")
    found = ranked(found, "fused" if "fused" in found.columns else "score")
    if external is not None:
        found = rerank(found, external, k).withColumn("rank", F.col("new_rank"))
        layers.append("reranker")
    text = kept.select("id", tx.trim_to_sentence(F.btrim("content", F.lit(" \t\n\r\f\x0b")), snippet).alias("snippet"))
    shown = ["query_id", "id", "source", F.round("score", 6).alias("score"), "snippet", (F.col("rank") - 1).cast("int").alias("rank"), F.round("bm25_score", 4).alias("bm25_score"), "mention_boost", *FACTORS]
    shown += [F.round("vector_score", 6).alias("vector_score")] if vectors is not None else []
    return found.where(F.col("rank") <= k).join(text, "id").select(*shown, F.array(*[F.lit(x) for x in layers]).alias("engaged_layers"))


def vector_stage(found: DataFrame, vectors: DataFrame, query_vectors: DataFrame, n: int, blend: str) -> DataFrame:
    """found (ranked pools of query_id, id, score, rank) with embedding, cosine, vector_score (of the best n of a query's pool) and `fused`, by which to rank.

    blend: 'rrf' (60) of the pool's order and the vector order, or 'linear' (0.4 min-max score + 0.6 cosine).
    """
    q = query_vectors.select("query_id", F.col("embedding").alias("_q"))
    both = found.join(vectors.select("id", "embedding"), "id", "left").join(q, "query_id", "left")
    both = both.withColumn("cosine", F.when(F.col("embedding").isNotNull() & F.col("_q").isNotNull(), cosine(F.col("embedding"), F.col("_q")))).drop("_q")
    order = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc_nulls_last(), "id")
    both = both.withColumn("_v", F.when(F.col("cosine").isNotNull(), F.row_number().over(order))).withColumn("_v", F.when(F.col("_v") <= n, F.col("_v")))
    both = both.withColumn("vector_score", F.when(F.col("_v").isNotNull(), F.col("cosine")))
    if blend == "linear":
        fused = 0.4 * minmax("score", ["query_id"]) + 0.6 * F.greatest(F.coalesce("vector_score", F.lit(0.0)), F.lit(0.0))
    else:
        fused = 1.0 / (60 + F.col("rank")) + F.coalesce(1.0 / (60 + F.col("_v")), F.lit(0.0))
    return both.withColumn("fused", fused).drop("_v")


def full_text_search(rows: DataFrame, queries: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """BM25 over the columns' texts joined by spaces."""
    joined = rows.select(F.col(id_col).alias("id"), F.concat_ws(" ", *columns).alias("all"))
    return bm25(tokens(joined, "id", "all"), query_terms(queries, "query_id", "text"))


def search_by_recency(rows: DataFrame, queries: DataFrame, columns: list[str], id_col: str, newest: str, k: int) -> DataFrame:
    """(query_id, id, rank): the k newest of the rows that match a query by a term; of all rows where none does."""
    hits = full_text_search(rows, queries, columns, id_col).select("query_id", "id").join(rows.select(F.col(id_col).alias("id"), F.col(newest).alias("_t")), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("_t"), "id")
    found = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank")
    latest = rows.select(F.col(id_col).alias("id"), F.col(newest).alias("_t")).orderBy(F.desc("_t"), "id").limit(k)  # k rows
    latest = latest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_t"), "id"))).select("id", "rank")
    missed = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(missed.crossJoin(F.broadcast(latest)))


def cached_hybrid(lexical: DataFrame, vector: DataFrame, alpha: float) -> DataFrame:
    """alpha x min-max lexical (flat: 0) + (1 - alpha) x clamped cosine over the valid cached rows."""
    both = lexical.select("query_id", "id", F.col("score").alias("_l")).join(vector.select("query_id", "id", F.col("score").alias("_v")), ["query_id", "id"], "full_outer")
    l = minmax(F.coalesce("_l", F.lit(0.0)), ["query_id"])  # noqa: E741
    return both.select("query_id", "id", (alpha * l + (1 - alpha) * F.greatest(F.coalesce("_v", F.lit(0.0)), F.lit(0.0))).alias("score"))


def session_relevance(blocks: DataFrame, tasks: DataFrame) -> DataFrame:
    """0.6 x share of the block's tags in the task + 0.4 x share of the task's words in the block, to six places; pairs that share neither are absent (they score 0).

    Blocks' entries that some task asks for are dealt by block, never by tag or word, so one that stands in every block loads no partition. They meet
    the tasks' entries as a broadcast list of QUERY_TERMS rows at most; more tasks are shuffled by entry and salt, copies of the tasks' rows to each salt.
    """

    def of(kind: str) -> Column:
        return F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))

    def entries(rows: DataFrame, key: str, n: str) -> DataFrame:
        return rows.select(key, n, F.explode(F.concat(of("tags"), of("words"))).alias("e")).select(key, n, "e.kind", "e.x")

    t = tasks.select("task_id", F.array_distinct(tx.tokenize(F.col("task"))).alias("words"), tx.word_set(F.lower("task")).alias("tags"))
    b = blocks.select("id", F.array_distinct(F.transform("tags", F.lower)).alias("tags"), F.array_distinct(tx.tokenize(F.col("content"))).alias("words"))
    asked = entries(t.withColumn("n_words", F.size("words")), "task_id", "n_words")
    held = entries(b.withColumn("n_tags", F.size("tags")), "id", "n_tags").join(asked.select("kind", "x").distinct(), ["kind", "x"], "left_semi")
    if asked.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS:
        met = held.repartition(parts(b, asked, "task_id"), "id").join(F.broadcast(asked), ["kind", "x"])
    else:
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "x", "salt"])
    common = met.groupBy("task_id", "id").agg(F.count_if(F.col("kind") == "tags").alias("tags"), F.count_if(F.col("kind") == "words").alias("words"), F.max("n_tags").alias("n_tags"), F.max("n_words").alias("n_words"))
    share = lambda c: F.when(F.col(c) > 0, F.col(c) / F.col(f"n_{c}")).otherwise(0.0)
    return common.select("task_id", "id", F.round(0.6 * share("tags") + 0.4 * share("words"), 6).alias("score"))
