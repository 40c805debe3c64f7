"""Recall, ranking and fusion queries over `documents`, `benchmark` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.functions import vectors as vx
from engram.functions.text import STOPWORDS
from engram.operators import fusion as fu
from engram.operators import lexical as lx
from engram.operators import scenarios as sc
from engram.operators import vector as ve
from engram.operators.ranking import global_rank
from engram.plans.registry import query, table

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tok_sql(text: str) -> str:
    return rf"list_filter(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9_]+')), lambda x: x NOT IN ({STOP}))"


#: documents as blocks: three documents a file, sources deal into four labels, newer documents have larger ids.
LEX = rf"""WITH docs AS (SELECT doc_id AS id, doc_id // 3 AS file, ['memory', 'rule', 'discovery', 'session'][1 + CAST(substr(source, 4) AS BIGINT) % 4] AS source, lang AS project, text AS content,
 row_number() OVER (ORDER BY doc_id DESC) - 1 AS recency_rank, CASE WHEN doc_id % 5 = 0 THEN doc_id % 9 END AS hits, {tok_sql('text')} AS tok FROM documents),
q AS (SELECT item_id AS query_id, text, {tok_sql('text')} AS tok FROM benchmark),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tok) AS term FROM docs) GROUP BY ALL), dl AS (SELECT id, len(tok) AS dl FROM docs), st AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM docs),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(tok) AS term FROM q) GROUP BY ALL),
s AS (SELECT query_id, id, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY ALL)
"""


def blocks(spark, sf):
    d = table(spark, sf, "documents")
    names = F.array(*[F.lit(x) for x in ("memory", "rule", "discovery", "session")])
    ranks = global_rank(d.select(F.col("doc_id").alias("id")), "id", "id", descending=True, name="recency_rank")
    out = d.select(
        F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 3).alias("file"), F.get(names, (F.substring("source", 4, 9).cast("int") % 4)).alias("source"), F.col("lang").alias("project"),
        F.col("text").alias("content"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 9).alias("hits"),
    )
    return out.join(ranks, "id")


def queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def scored(spark, sf, allowed=None):
    tok = lx.tokens(table(spark, sf, "documents"), "doc_id", "text")
    return lx.bm25(tok, lx.query_terms(queries(spark, sf), "query_id", "text"), allowed)


def out(df, *cols, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in ("score", "fused", "composite") else F.col(c) for c in cols])


TOP = " SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {rows}) WHERE rank <= {k}"


@query("rk1_corpus_statistics", LEX + "SELECT term, df, CAST(sum(tf) AS BIGINT) AS tf, max(n) AS n, round(max(avgdl), 6) AS avgdl FROM p JOIN df USING (term), st GROUP BY ALL")
def rk1(spark, sf):
    tok = lx.tokens(table(spark, sf, "documents"), "doc_id", "text")
    terms = lx.postings(tok).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return terms.crossJoin(F.broadcast(lx.corpus_statistics(tok))).withColumn("avgdl", F.round("avgdl", 6))


@query("rk2_bm25_topk", LEX + TOP.format(rows="s", k=5))
def rk2(spark, sf):
    return out(fu.top_k(scored(spark, sf), 5), "query_id", "id", "rank", "score")


@query("rk3_bm25_masked", LEX + TOP.format(rows="(SELECT * FROM s WHERE id % 3 <> 0)", k=5))
def rk3(spark, sf):
    allowed = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))
    return out(fu.top_k(scored(spark, sf, allowed), 5), "query_id", "id", "rank", "score")


FIELD = ", f AS (SELECT DISTINCT id, unnest(tok[1:3]) AS term FROM docs), h AS (SELECT DISTINCT query_id, id FROM qt JOIN f USING (term)), b AS (SELECT query_id, id, CASE WHEN h.id IS NULL THEN score ELSE score * 1.2 END AS score FROM s LEFT JOIN h USING (query_id, id))"


@query("rk4_field_boost", LEX + FIELD + TOP.format(rows="b", k=5))
def rk4(spark, sf):
    tok = lx.tokens(table(spark, sf, "documents"), "doc_id", "text")
    fields = tok.select("id", F.explode(F.slice("tok", 1, 3)).alias("term"))
    terms = lx.query_terms(queries(spark, sf), "query_id", "text")
    return out(fu.top_k(lx.field_boost(lx.bm25(tok, terms), terms, fields), 5), "query_id", "id", "rank", "score")


FACTORS = r""", w AS (SELECT id, regexp_extract_all(content, '[a-zA-Z]{2,}') AS w FROM docs),
fac AS (SELECT id, file, source, project, CASE source WHEN 'memory' THEN 1.0::DOUBLE WHEN 'rule' THEN 0.95::DOUBLE WHEN 'discovery' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END / (1 + recency_rank * 0.01::DOUBLE)
 * CASE WHEN len(w.w) <= 20 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(1.0::DOUBLE, len(list_distinct(list_transform(w.w, lambda x: lower(x)))) / len(w.w) / 0.2::DOUBLE)) END * least(1.0::DOUBLE + 0.1::DOUBLE * coalesce(hits, 0), 1.5::DOUBLE) AS factor FROM docs JOIN w USING (id)),
c AS (SELECT query_id, id, file, source, score * factor * CASE WHEN length(project) >= 4 AND contains(lower(q.text), lower(project)) THEN 2.0 ELSE 1.0 END AS score FROM s JOIN fac USING (id) JOIN q USING (query_id)),
bf AS (SELECT query_id, id, file, source, round(score, 4) AS score FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, file ORDER BY round(score, 9) DESC, id) = 1)"""


def composite(spark, sf):
    return lx.composite_recall(scored(spark, sf), blocks(spark, sf), queries(spark, sf))


@query("rk5_composite_recall", LEX + FACTORS + TOP.format(rows="c", k=10))
def rk5(spark, sf):
    return out(fu.top_k(composite(spark, sf), 10), "query_id", "id", "rank", "score")


@query("rk6_best_per_file", LEX + FACTORS + "SELECT query_id, file, id, score FROM bf")
def rk6(spark, sf):
    return lx.best_per_file(composite(spark, sf)).select("query_id", "file", "id", "score")


#: Recall end to end: blocks that aren't ambient traces, a vector for each block and query, gates, and external scores for every second block.
RECALL = (LEX.replace("WITH docs AS (", "WITH docs0 AS (").replace("FROM documents),", "FROM documents), docs AS (SELECT * FROM docs0 WHERE id % 6 <> 0),") + FACTORS + """, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM bf QUALIFY place <= 50),
em AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), pv AS (SELECT pool.*, a.x AS e, CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN list_cosine_similarity(a.x, b.x) END AS cos FROM pool LEFT JOIN em a ON a.vec_id = pool.id LEFT JOIN em b ON b.vec_id = pool.query_id),
vr AS (SELECT *, CASE WHEN cos IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC NULLS LAST, id) END AS v FROM pv),
fu AS (SELECT *, 1.0 / (60 + place) + CASE WHEN v <= 10 THEN 1.0 / (60 + v) ELSE 0 END AS fused FROM vr),
nr AS (SELECT a.query_id, a.id, max(list_cosine_similarity(a.e, b.e)) AS nearest FROM fu a JOIN fu b ON a.query_id = b.query_id AND a.id <> b.id WHERE a.e IS NOT NULL AND b.e IS NOT NULL GROUP BY ALL),
ga AS (SELECT *, coalesce(cos, 0) >= 0.3 AND coalesce(nearest, 0) >= 0.3 AND 0.7 * coalesce(cos, 0) + 0.3 * CASE WHEN count(*) OVER w = 1 THEN 1 ELSE percent_rank() OVER (PARTITION BY query_id ORDER BY score) END >= 0.4 AS ok FROM fu LEFT JOIN nr USING (query_id, id) WINDOW w AS (PARTITION BY query_id)),
kp AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM ga) WHERE ok OR NOT any_ok), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS fr FROM kp),
ou AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN id % 2 = 0 THEN id % 13 END DESC NULLS LAST, fr) AS r FROM rr)
SELECT query_id, id, round(score, 6) AS score, round(s.score, 4) AS bm25_score, CASE WHEN v <= 10 THEN round(cos, 6) END AS vector_score, CAST(r - 1 AS INTEGER) AS rank, 'bm25,embedding,fusion_gates,reranker' AS layers, left(regexp_replace(content, '^\\s+', ''), 20) AS snippet
FROM (SELECT query_id, id, score, v, cos, r FROM ou WHERE r <= 5) o JOIN (SELECT query_id, id, score FROM s) s USING (query_id, id) JOIN (SELECT id, content FROM docs) d USING (id)""").replace("SELECT query_id, id, round(score, 6) AS score, round(s.score, 4)", "SELECT query_id, id, round(o.score, 6) AS score, round(s.score, 4)")


@query("rk7_recall", RECALL)
def rk7(spark, sf):
    b = blocks(spark, sf).withColumn("type", F.when(F.col("id") % 6 == 0, "ambient_trace"))
    v, q = table(spark, sf, "embeddings").select("vec_id", "embedding"), queries(spark, sf)
    external = b.where("id % 2 = 0").select("id", (F.col("id") % 13).alias("ext"))  # scores by block, for every query
    found = lx.recall(b, q, 5, v.withColumnRenamed("vec_id", "id"), v.withColumnRenamed("vec_id", "query_id"), gates=True, external=external)
    return found.select("query_id", "id", "score", "bm25_score", "vector_score", "rank", F.array_join("engaged_layers", ",").alias("layers"), F.substring("snippet", 1, 20).alias("snippet"))


@query("rk8_recency_recall", "SELECT doc_id AS id, 0.5 AS score FROM documents ORDER BY doc_id DESC LIMIT 20")
def rk8(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score")).orderBy(F.desc("id")).limit(20)


@query("rk9_index_mode", "SELECT doc_id // 3 AS file, doc_id AS id, left(text, 80) AS title FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id DESC) = 1")
def rk9(spark, sf):
    from engram.operators.telemetry import newest

    rows = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("file"), F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"))
    return newest(rows, ["file"], "id", "id", 1)


@query("rk10_timeline", "SELECT doc_id AS id, source FROM documents ORDER BY doc_id DESC LIMIT 50")
def rk10(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source").orderBy(F.desc("id")).limit(50)


@query("rk11_hits_boost", LEX + "SELECT id, least(1.0::DOUBLE + 0.1::DOUBLE * coalesce(hits, 0), 1.5::DOUBLE) AS boost FROM docs")
def rk11(spark, sf):
    return blocks(spark, sf).select("id", lx.hits_boost(F.col("hits")).alias("boost"))


FTS = LEX.replace("text AS content", "text || ' ' || lang || ' ' || source AS content").replace(tok_sql("text") + " AS tok FROM documents", tok_sql("text || ' ' || lang || ' ' || source") + " AS tok FROM documents")


NEWEST = FTS + ", m AS (SELECT query_id, id FROM s UNION ALL SELECT query_id, id FROM q, docs WHERE query_id NOT IN (SELECT query_id FROM s)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 1000 DESC, id) AS rank FROM m QUALIFY rank <= 5"


@query("rk12_search_by_recency", NEWEST)
def rk12_recency(spark, sf):
    d = table(spark, sf, "documents").withColumn("updated", F.col("doc_id") % 1000)
    return lx.search_by_recency(d, queries(spark, sf), ["text", "lang", "source"], "doc_id", "updated", 5)


@query("rk12_full_text_search", FTS + TOP.format(rows="s", k=5))
def rk12(spark, sf):
    return out(fu.top_k(lx.full_text_search(table(spark, sf, "documents"), queries(spark, sf), ["text", "lang", "source"], "doc_id"), 5), "query_id", "id", "rank", "score")


#: Vector pools: queries are the vectors whose id is divisible by 20, candidates all others.
VEC = """WITH a AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS y, label FROM embeddings),
v AS (SELECT query_id, id, label, list_cosine_similarity(x, y) AS score FROM a, b WHERE id <> query_id)
"""
#: One pool of each query: its ten nearest with a score, a rank and a source weight.
POOL = VEC + """, pool AS (SELECT *, 1 + (id % 7) AS lex, 0.7 + (label % 4) * 0.1 AS source_weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM v) WHERE rank <= 10)
"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_hits(spark, sf):
    e = vectors(spark, sf)
    return ve.vector_topk(e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)


def pool(spark, sf):
    p = vector_hits(spark, sf).join(vectors(spark, sf), "id")
    return p.withColumn("lex", 1 + F.col("id") % 7).withColumn("source_weight", 0.7 + (F.col("label") % 4) * 0.1)


@query("rk13_vector_topk", VEC + TOP.format(rows="v", k=10))
def rk13(spark, sf):
    return out(vector_hits(spark, sf), "query_id", "id", "rank", "score")


@query("rk14_lsh_search")
def rk14(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return out(ve.lsh_search(e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10), "query_id", "id", "rank", "score")


GUARDED = """WITH a AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x, ['g' || vec_id % 3, 'u' || vec_id % 7] AS principals FROM embeddings WHERE vec_id % 20 = 0),
b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS y, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN [] ELSE ['g' || label % 3, 'u' || vec_id % 5] END AS acl FROM embeddings),
v AS (SELECT query_id, id, greatest(least(list_cosine_similarity(x, y), 1), 0) AS score FROM a, b WHERE id <> query_id AND list_has_any(acl, principals))"""


def guarded(spark, sf):
    """Vectors with ACLs (some null, some empty) and queries with principals."""
    e, m = vectors(spark, sf), F.col("id")
    name = lambda p, c, n: F.concat(F.lit(p), (c % n).cast("string"))
    acl = F.when(m % 11 == 0, None).when(m % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(name("g", F.col("label"), 3), name("u", m, 5)))
    q = e.where("id % 20 = 0").select(m.alias("query_id"), "embedding", F.array(name("g", m, 3), name("u", m, 7)).alias("principals"))
    return e.select("id", "embedding", acl.alias("acl")), q


@query("rk14_acl_search")
def rk14b(spark, sf):
    return out(ve.lsh_search(*guarded(spark, sf), 10), "query_id", "id", "rank", "score")


@query("rk14_acl_exact_mode", GUARDED + TOP.format(rows="v", k=10))
def rk14c(spark, sf):
    return out(ve.lsh_search(*guarded(spark, sf), 10, exact=True), "query_id", "id", "rank", "score")


@query("rk20_cluster_search", VEC + TOP.format(rows="v", k=10))
def rk20(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return out(ve.cluster_search(e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10), "query_id", "id", "rank", "score")


LISTS = LEX + ", x AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 20), y AS (SELECT query_id, id, 1.0 / (1 + id % 10) AS score, row_number() OVER (PARTITION BY query_id ORDER BY id % 10, id) AS rank FROM s QUALIFY rank <= 20)"


def two_lists(spark, sf):
    s = scored(spark, sf)
    y = s.withColumn("score", 1.0 / (1 + F.col("id") % 10))
    return fu.top_k(s, 20), fu.top_k(y, 20)


RRF = "(SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM x UNION ALL SELECT query_id, id, rank FROM y) GROUP BY ALL)"


@query("rk15_reciprocal_rank_fusion", LISTS + TOP.format(rows=RRF, k=10))
def rk15(spark, sf):
    return out(fu.top_k(fu.reciprocal_rank_fusion(list(two_lists(spark, sf))), 10), "query_id", "id", "rank", "score")


@query("rk16_two_list_fusion", LISTS + " SELECT query_id, id, round(coalesce(1.0 / (60 + x.rank), 0) + coalesce(1.0 / (60 + y.rank), 0), 6) AS score, round(coalesce(y.score, x.score), 6) AS shown FROM x FULL JOIN y USING (query_id, id)")
def rk16(spark, sf):
    x, y = two_lists(spark, sf)
    both = x.select("query_id", "id", F.col("rank").alias("r1"), F.col("score").alias("s1")).join(y.select("query_id", "id", F.col("rank").alias("r2"), F.col("score").alias("s2")), ["query_id", "id"], "full_outer")
    score = F.coalesce(1.0 / (60 + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("r2")), F.lit(0.0))
    return both.select("query_id", "id", F.round(score, 6).alias("score"), F.round(F.coalesce("s2", "s1"), 6).alias("shown"))


@query("rk17_linear_blend", LISTS + TOP.format(rows="""(SELECT query_id, id, 0.4 * coalesce(l, 0) + 0.6 * greatest(coalesce(y.score, 0), 0) AS score FROM (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS l
FROM x WINDOW w AS (PARTITION BY query_id)) FULL JOIN y USING (query_id, id))""", k=10))
def rk17(spark, sf):
    return out(fu.top_k(fu.linear_blend(*two_lists(spark, sf)), 10), "query_id", "id", "rank", "score")


@query("rk18_layer_blend", LISTS + " SELECT query_id, id, round(0.6 * coalesce(x.score, 0) + 0.4 * coalesce(y.score, 0), 6) AS score, CASE WHEN x.id IS NULL THEN 'vector' WHEN y.id IS NULL THEN 'lexical' ELSE 'fused' END AS layer FROM x FULL JOIN y USING (query_id, id)")
def rk18(spark, sf):
    return fu.layer_blend(*two_lists(spark, sf))


@query("rk19_weighted_fusion", POOL + "SELECT query_id, id, round(lex * count(*) OVER w * (exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w) * source_weight, 6) AS fused FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM pool) WINDOW w AS (PARTITION BY query_id)")
def rk19(spark, sf):
    p = pool(spark, sf).withColumnRenamed("score", "cosine").withColumnRenamed("lex", "score")
    return out(fu.weighted_fusion(p), "query_id", "id", "fused")


@query("rk21_parallel_gates", POOL + """, n AS (SELECT p.query_id, p.id, max(list_cosine_similarity(e.y, f.y)) AS nearest FROM pool p JOIN pool o ON o.query_id = p.query_id AND o.id <> p.id JOIN b e ON e.id = p.id JOIN b f ON f.id = o.id GROUP BY ALL),
g AS (SELECT query_id, id, score, nearest, 0.7 * score + 0.3 * percent_rank() OVER (PARTITION BY query_id ORDER BY lex) AS delta FROM pool JOIN n USING (query_id, id)),
k AS (SELECT *, score >= 0.3 AND nearest >= 0.3 AND delta >= 0.4 AS ok FROM g) SELECT query_id, id, round(delta, 6) AS delta, fallback FROM (SELECT *, NOT bool_or(ok) OVER (PARTITION BY query_id) AS fallback FROM k) WHERE ok OR fallback""")
def rk21(spark, sf):
    p = pool(spark, sf)
    near = ve.nearest_in_pool(p)
    rows = p.join(near, ["query_id", "id"]).withColumnRenamed("score", "cosine").withColumnRenamed("lex", "score")
    return fu.parallel_gates(rows).select("query_id", "id", F.round("delta", 6).alias("delta"), "fallback")


@query("rk22_sequential_gates", POOL + """, o AS (SELECT p.*, CASE WHEN p.id % 3 <> 0 THEN y END AS e FROM pool p JOIN b USING (id)),
l AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o),
g AS (SELECT query_id, id, CASE WHEN score >= 0.3 THEN score ELSE score * 0.1::DOUBLE END * CASE WHEN last IS NULL OR e IS NULL THEN 1.0::DOUBLE WHEN list_cosine_similarity(e, last) >= 1 / 3 THEN 1.0::DOUBLE ELSE 1 / 3 END AS product FROM l)
SELECT query_id, id, round(product, 6) AS product FROM g WHERE product >= 0.1""")
def rk22(spark, sf):
    p = pool(spark, sf).withColumnRenamed("score", "cosine").withColumn("embedding", F.when(F.col("id") % 3 != 0, F.col("embedding")))
    return fu.sequential_gates(p).select("query_id", "id", F.round("product", 6).alias("product"))


@query("rk23_gate_fallback", POOL + """, k AS (SELECT query_id, count(*) FILTER (score >= 0.45) AS kept FROM pool GROUP BY 1) SELECT query_id, id, kept = 0 AS fallback FROM pool JOIN k USING (query_id) WHERE kept = 0 OR score >= 0.45""")
def rk23(spark, sf):
    return fu.fail_open(pool(spark, sf), F.col("score") >= 0.45).select("query_id", "id", "fallback")


@query("rk25_materialise", VEC + """, i AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (vec_id % 10) / 10 AS s, label % 2 AS store FROM embeddings WHERE vec_id % 2 = 1), st AS (SELECT vec_id, embedding::DOUBLE[] AS y, label % 2 AS store FROM embeddings WHERE vec_id % 2 = 0),
n AS (SELECT i.id, i.store, s, max(list_cosine_similarity(x, y)) AS nearest FROM i LEFT JOIN st ON st.store = i.store GROUP BY ALL), o AS (SELECT *, CASE WHEN s < 0.1 THEN 'below_score' WHEN coalesce(1 - nearest, 1) < 0.7 THEN 'not_novel' END AS o1 FROM n)
SELECT id, coalesce(o1, CASE WHEN row_number() OVER (PARTITION BY store, o1 IS NULL ORDER BY round(s, 9) DESC, id) <= 3 THEN 'stored' ELSE 'evicted' END) AS outcome FROM o""")
def rk25(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("store", F.col("label") % 2)
    new = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), "embedding", ((F.col("vec_id") % 10) / 10).alias("s"), "store")
    near = ve.vector_topk(e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "embedding", "store"), new, 1, ("store",))
    items = new.join(near.select("query_id", F.col("score").alias("nearest")), "query_id", "left").select(F.col("query_id").alias("id"), "store", F.col("s").alias("score"), "nearest", F.lit(False).alias("known"))
    return fu.materialise(items, capacity=3, novelty=0.7).select("id", "outcome")


@query("rk26_composite_score", POOL + """SELECT query_id, id, round(least(greatest(0.25 * score + 0.18 * CASE WHEN max(lex) OVER w > min(lex) OVER w THEN (lex - min(lex) OVER w) / (max(lex) OVER w - min(lex) OVER w) ELSE 0.5 END + 0.15 * 0.7 + 0.08 * (1.0 / rank), 0.0), 1.0), 6) AS composite FROM pool WINDOW w AS (PARTITION BY query_id)""")
def rk26(spark, sf):
    p = pool(spark, sf).withColumnRenamed("score", "semantic").withColumnRenamed("lex", "score").withColumn("recency", 1.0 / F.col("rank"))
    return out(fu.composite_score(p), "query_id", "id", "composite")


@query("rk27_rerank", POOL + """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN id % 2 = 0 THEN id % 13 END DESC NULLS LAST, rank) AS new_rank FROM pool QUALIFY new_rank <= 5""")
def rk27(spark, sf):
    p = pool(spark, sf)
    ext = p.where("id % 2 = 0").select("query_id", "id", (F.col("id") % 13).alias("ext"))
    return fu.rerank(p, ext, 5).select("query_id", "id", "new_rank")


@query("rk28_cached_hybrid", LISTS + TOP.format(rows="""(SELECT query_id, id, 0.6 * CASE WHEN max(l) OVER w > min(l) OVER w THEN (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) ELSE 0 END + 0.4 * greatest(v, 0) AS score FROM (SELECT query_id, id, coalesce(x.score, 0) AS l, coalesce(y.score, 0) AS v FROM x FULL JOIN y USING (query_id, id)) WINDOW w AS (PARTITION BY query_id))""", k=10))
def rk28(spark, sf):
    x, y = two_lists(spark, sf)
    return out(fu.top_k(lx.cached_hybrid(x, y, 0.6), 10), "query_id", "id", "rank", "score")


@query("rk29_session_relevance", LEX + """, t AS (SELECT query_id, list_distinct(tok) AS w, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS g FROM q),
bl AS (SELECT id, list_distinct([lower(project), lower(source), 'the']) AS g, list_distinct(tok) AS w FROM docs),
r AS (SELECT query_id, id, round(0.6 * len(list_intersect(bl.g, t.g)) / len(bl.g) + CASE WHEN len(t.w) > 0 THEN 0.4 * len(list_intersect(bl.w, t.w)) / len(t.w) ELSE 0 END, 6) AS score FROM t, bl)""" + TOP.format(rows="(SELECT * FROM r WHERE score > 0)", k=5))
def rk29(spark, sf):
    b = blocks(spark, sf).withColumn("tags", F.array(F.col("project"), F.col("source"), F.lit("the")))
    rel = lx.session_relevance(b, queries(spark, sf).select(F.col("query_id").alias("task_id"), F.col("text").alias("task")))
    return out(fu.top_k(rel.withColumnRenamed("task_id", "query_id"), 5), "query_id", "id", "rank", "score")


@query("rk32_best_block", LEX + """, t AS (SELECT query_id, unnest(list_distinct(tok)) AS w FROM q), c AS (SELECT query_id, id, count(*) FILTER (contains(lower(content), w)) AS score FROM t, docs GROUP BY ALL) SELECT query_id, id, score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""")
def rk32(spark, sf):
    one = F.lit("all").alias("project")
    asked = queries(spark, sf).select("query_id", one, F.array_distinct(F.coalesce(tx.tokenize(F.col("text")), F.array().cast("array<string>"))).alias("own"))
    found = sc.best_blocks(blocks(spark, sf).select(one, F.col("id").alias("position"), "content"), asked, F.col("own"))
    return found.select("query_id", F.col("position").alias("id"), "score")
