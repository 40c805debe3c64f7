"""Queries of clauses that stand beside the plain forms: whole hygiene, discovery pages, recall aggregates, publication edges, rates, evictions, backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import evaluation as ev
from engram.operators import filters as fl
from engram.operators import fusion as fu
from engram.operators import graph as gr
from engram.operators import joins as jn
from engram.operators import lifecycle as lc
from engram.operators import telemetry as t
from engram.operators import vector as ve
from engram.plans.governance import REC, WORDS, rec
from engram.plans.lifecycle import BOW, MATCHES, MEM, mem, recalled
from engram.plans.registry import query, table
from engram.plans.retrieval import VEC
from engram.sources import notes as so
from engram.sources import sinks as sk


@query("lc3_nightly_hygiene", MEM + f""", s AS (SELECT stem, project, age, {WORDS} AS w FROM (SELECT *, content AS text FROM mem) WHERE project IS NOT NULL), p AS (SELECT project, stem, age, len(w) AS n, unnest(w) AS x FROM s),
d AS (SELECT DISTINCT CASE WHEN ba < aa THEN a ELSE b END AS stem FROM (SELECT a.stem AS a, b.stem AS b, any_value(a.age) AS aa, any_value(b.age) AS ba, count(*) / any_value(greatest(a.n, b.n)) AS sim FROM p a JOIN p b ON a.project = b.project AND a.x = b.x AND a.stem < b.stem GROUP BY ALL) WHERE sim >= 0.92),
c AS (SELECT dc.*, d.stem IS NOT NULL AS dup FROM dc LEFT JOIN d USING (stem)), g AS (SELECT *, NOT pinned AND (((superseded OR dup) AND age >= 7) OR age > 90) AND stem NOT IN (SELECT stem FROM rc) AS gone FROM c),
r AS (SELECT project, count(*) AS total, count(*) FILTER (outcome = 'decayed') AS decayed, count(*) FILTER (outcome = 'archived') AS archived, count(*) FILTER (outcome IN ('pinned', 'already_decayed')) AS skipped, count(*) FILTER (dup) AS duplicates_merged, count(*) FILTER (gone) AS candidates_pruned FROM g GROUP BY 1),
k AS (SELECT ['de', 'en', 'es', 'fr', 'it'][1 + user_id % 5] AS project, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS checkpoints_expired FROM events GROUP BY 1)
SELECT project, coalesce(total, 0) AS total, coalesce(decayed, 0) AS decayed, coalesce(archived, 0) AS archived, coalesce(skipped, 0) AS skipped, coalesce(duplicates_merged, 0) AS duplicates_merged, coalesce(candidates_pruned, 0) AS candidates_pruned, coalesce(checkpoints_expired, 0) AS checkpoints_expired FROM r FULL JOIN k USING (project)""")
def lc3b(spark, sf):
    names = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "it")])
    checkpoints = table(spark, sf, "events").select(F.get(names, (F.col("user_id") % 5).cast("int")).alias("project"), (F.col("ts") + F.expr("INTERVAL '726' DAY")).alias("created_at"))
    return lc.nightly_hygiene(mem(spark, sf), recalled(spark, sf), checkpoints, 9, "2026-01-10", ttl_days=0)


@query("fl12_discovery_page", REC + """, d AS (SELECT id, project, room AS agent, CASE WHEN id % 7 <> 0 THEN DATE '2024-01-01' + CAST(id % 90 AS INTEGER) END AS date, [level, coalesce(type, 'none')] AS tags, acl FROM rec),
m AS (SELECT * FROM d WHERE coalesce(list_has_any(acl, ['ann', 'team']), false) AND (date IS NULL OR date BETWEEN DATE '2024-01-10' AND DATE '2024-03-01') AND project = 'en' AND list_has_all(tags, ['decision']))
SELECT id, strftime(date, '%Y-%m-%d') AS date, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 13 THEN 13 END AS next_offset FROM m ORDER BY id LIMIT 10 OFFSET 3""")
def fl12b(spark, sf):
    day = F.when(F.col("id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")))
    d = rec(spark, sf).select("id", "project", F.col("room").alias("agent"), day.alias("date"), F.array("level", F.coalesce("type", F.lit("none"))).alias("tags"), "acl")
    page = fl.discovery_page(d, ["ann", "team"], "2024-01-10", "2024-03-01", project="en", tags=("decision",), offset=3, limit=10)
    return page.select("id", F.date_format("date", "yyyy-MM-dd").alias("date"), "total", "next_offset")


@query("ag10_recall_aggregate", """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS mode, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || user_id % 4 END AS version, CASE WHEN event_id % 11 <> 0 THEN value * 10 END AS latency, user_id % 6 AS results FROM events),
l AS (SELECT latency, row_number() OVER (ORDER BY latency, event_id) - 1 AS i, count(*) OVER () AS n FROM e WHERE latency IS NOT NULL)
SELECT (SELECT count(*) FROM e) AS total_events, (SELECT round(sum(latency), 3) FROM e) AS total_latency_ms, (SELECT round(avg(latency), 3) FROM e) AS avg_latency_ms, (SELECT round(max(latency), 3) FROM l WHERE i = CASE WHEN n <= 20 THEN n - 1 ELSE n * 95 // 100 END) AS p95_latency_ms,
(SELECT round(avg(results), 2) FROM e) AS avg_result_count, (SELECT string_agg(k || '=' || c, ',' ORDER BY k || '=' || c) FROM (SELECT coalesce(mode, 'unknown') AS k, count(*) AS c FROM e GROUP BY 1)) AS modes, (SELECT string_agg(k || '=' || c, ',' ORDER BY k || '=' || c) FROM (SELECT version AS k, count(*) AS c FROM e WHERE version <> '' GROUP BY 1)) AS versions""")
def ag10b(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select(i, F.when(i % 5 != 0, F.col("event_type")).alias("mode"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string"))).alias("version"), F.when(i % 11 != 0, F.col("value") * 10).alias("latency_ms"), (F.col("user_id") % 6).alias("results"))
    return t.recall_aggregate(e).withColumns({c: F.round(c, n) for c, n in (("total_latency_ms", 3), ("avg_latency_ms", 3), ("p95_latency_ms", 3), ("avg_result_count", 2))})


@query("ag17_folded_merge", """WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Café ' || c_custkey % 100 WHEN 1 THEN 'cafe_' || c_custkey % 100 WHEN 2 THEN 'CAFÉ-' || c_custkey % 100 ELSE 'ﬁne Naïve' || c_custkey % 100 END AS name, c_mktsegment AS type FROM customer),
k AS (SELECT *, CASE id % 4 WHEN 3 THEN 'finenaive' ELSE 'cafe' END || id % 100 AS f FROM e) SELECT arg_min(id, id) AS entity_id, arg_min(name, id) AS name, type, count(*) AS merged FROM k GROUP BY f, type""")
def ag17b(spark, sf):
    c = table(spark, sf, "customer")
    m = F.col("c_custkey")
    tail = (m % 100).cast("string")
    name = F.when(m % 4 == 0, F.concat(F.lit("Café "), tail)).when(m % 4 == 1, F.concat(F.lit("cafe_"), tail)).when(m % 4 == 2, F.concat(F.lit("CAFÉ-"), tail)).otherwise(F.concat(F.lit("ﬁne Naïve"), tail))
    e = c.select(m.alias("entity_id"), name.alias("name"), F.col("c_mktsegment").alias("type"), F.array(F.lit("f")).alias("source_files"), F.lit(0.5).alias("confidence"), m.alias("first_seen"), F.lit(None).cast("array<string>").alias("acl_allow"))
    return jn.merge_entities(e, folded=True).select("entity_id", "name", "type", "merged")


@query("ag25_table_counts", "SELECT 'events' AS table, count(*) AS records FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def ag25b(spark, sf):
    return t.table_counts(**{n: table(spark, sf, n) for n in ("events", "documents", "conversations", "embeddings")})


@query("gr12_published_edges", """WITH e AS (SELECT event_id, user_id AS agent, ts, left(sha256(event_type || CAST(user_id % 9 AS VARCHAR)), 12) AS m FROM events), f AS (SELECT m, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY 1)
SELECT agent AS source_id, e.m AS target_id, left(sha256(agent || '' || e.m || 'AGENT_PUBLISHED'), 12) AS edge_id, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id, strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS publications, arg_min(e.event_id, (e.ts, e.event_id)) <> any_value(f.event_id) AS is_duplicate FROM e JOIN f USING (m) GROUP BY 1, 2, 3""")
def gr12b(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 9).cast("string")).alias("content"), F.col("user_id").alias("agent"), "ts")
    return gr.publications(e).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("ev3_composite", "WITH s AS (SELECT event_type AS category, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1) SELECT category, round(mean, 6) AS mean, n, round(least(greatest(mean / 20, 0), 1), 6) AS normalised, round(avg(mean) OVER (), 6) AS composite FROM s")
def ev3b(spark, sf):
    s = ev.composite(ev.category_stats(table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("value").alias("score"))), 20.0)
    return s.drop("sd").withColumns({c: F.round(c, 6) for c in ("mean", "normalised", "composite")})


def turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where("turn % 2 = 0").select(F.col("conv_id").alias("file"), F.col("turn").alias("i"), "text"), c.where("turn % 2 = 1").select(F.col("conv_id").alias("file"), F.col("turn").alias("j"), "text")


@query("ev7_match_rates", "SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (" + MATCHES + "))")
def ev7b(spark, sf):
    return ev.match_rates(ev.greedy_matches(*turns(spark, sf), 0.2)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("ev8_miss_rates", BOW + """, bs AS (SELECT c.conv_id AS file, c.turn AS i, coalesce(max(sim), 0) AS best FROM conversations c LEFT JOIN s ON s.file = c.conv_id AND s.i = c.turn WHERE c.turn % 2 = 0 AND c.conv_id % 3 <> 0 GROUP BY ALL),
r AS (SELECT count(*) AS targets, count(*) FILTER (round(best, 9) >= 0.25) AS found FROM bs) SELECT targets, found, round(1 - found / nullif(targets, 0), 6) AS miss_rate, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 3 = 0) AS clean_files, (SELECT count(*) FROM conversations WHERE conv_id % 3 = 0 AND turn % 2 = 1) AS false_positives FROM r""")
def ev8b(spark, sf):
    want, got = turns(spark, sf)
    best = ev.best_similarity(want.where("file % 3 <> 0"), got)
    clean = table(spark, sf, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").alias("file"))
    return ev.miss_rates(best, got, clean, 0.25).withColumn("miss_rate", F.round("miss_rate", 6))


@query("rk25_store_eviction", VEC + """, i AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (vec_id % 10) / 10 AS s, label % 2 AS store FROM embeddings WHERE vec_id % 2 = 1), st AS (SELECT vec_id AS id, embedding::DOUBLE[] AS y, (vec_id % 8) / 8 AS s, label % 2 AS store FROM embeddings WHERE vec_id % 2 = 0),
n AS (SELECT i.id, i.store, i.s, max(list_cosine_similarity(x, y)) AS nearest FROM i LEFT JOIN st ON st.store = i.store GROUP BY ALL), o AS (SELECT id, store, s, true AS is_new, CASE WHEN s < 0.1 THEN 'below_score' WHEN coalesce(1 - nearest, 1) < 0.7 THEN 'not_novel' END AS o1 FROM n UNION ALL SELECT id, store, s, false, NULL FROM st)
SELECT id, is_new, coalesce(o1, CASE WHEN row_number() OVER (PARTITION BY store, o1 IS NULL ORDER BY round(s, 9) DESC, is_new, id) > 60 THEN 'evicted' WHEN is_new THEN 'stored' ELSE 'kept' END) AS outcome FROM o""")
def rk25b(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("store", F.col("label") % 2)
    old = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "embedding", "store", ((F.col("vec_id") % 8) / 8).alias("score"))
    new = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), "embedding", ((F.col("vec_id") % 10) / 10).alias("s"), "store")
    near = ve.vector_topk(old, new, 1, ("store",))
    items = new.join(near.select("query_id", F.col("score").alias("nearest")), "query_id", "left").select(F.col("query_id").alias("id"), "store", F.col("s").alias("score"), "nearest", F.lit(False).alias("known"))
    return fu.materialise_into(items, old, capacity=60, novelty=0.7).select("id", "is_new", "outcome")


@query("lc10_backfill_lines", """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{broken ' || doc_id WHEN doc_id % 5 = 1 THEN '{}' WHEN doc_id % 5 = 2 THEN '{"id":' || doc_id || ',"acl_allow":null}' WHEN doc_id % 5 = 3 THEN '{"id":' || doc_id || ',"classification":"public"}' ELSE '{"acl_allow":["a"],"classification":"public","id":' || doc_id || '}' END AS value FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'malformed' WHEN 4 THEN 'kept' ELSE 'filled' END AS outcome, CASE doc_id % 5 WHEN 1 THEN '{"acl_allow":["team"],"classification":"internal"}' WHEN 2 THEN '{"id":' || doc_id || ',"acl_allow":["team"],"classification":"internal"}' WHEN 3 THEN '{"id":' || doc_id || ',"classification":"public","acl_allow":["team"]}' ELSE value END AS line FROM l""")
def lc10b(spark, sf):
    m = F.col("doc_id")
    n = m.cast("string")
    value = (
        F.when(m % 5 == 0, F.concat(F.lit("{broken "), n)).when(m % 5 == 1, "{}").when(m % 5 == 2, F.concat(F.lit('{"id":'), n, F.lit(',"acl_allow":null}')))
        .when(m % 5 == 3, F.concat(F.lit('{"id":'), n, F.lit(',"classification":"public"}'))).otherwise(F.concat(F.lit('{"acl_allow":["a"],"classification":"public","id":'), n, F.lit("}")))
    )
    lines = table(spark, sf, "documents").select("doc_id", value.alias("value"))
    done = lc.backfill_lines(lines.select("value").distinct(), ["team"], "internal")
    return lines.join(done, "value").select("doc_id", "outcome", "line")


@query("rk31_prefiltered_context", MEM + """, q AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: len(w) >= 3)) AS w FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
h AS (SELECT stem, importance FROM mem, q WHERE project = 'en' AND list_has_any(list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda w: len(w) >= 3), w))
SELECT stem, round(0.15 * importance + 0.18 * 0.5 + 0.08 * 0.5, 6) AS composite FROM h ORDER BY 2 DESC, stem LIMIT 10""")
def rk31b(spark, sf):
    """The memories of a project that share a word with the context (the first benchmark item), by confidence."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 3))
    asked = table(spark, sf, "benchmark").orderBy("item_id").limit(1).select(F.explode(words("text")).alias("word"))  # one context's words
    held = mem(spark, sf).where("project = 'en'").select("stem", "importance", F.explode(words("content")).alias("word"))
    rows = held.join(asked, "word", "left_semi").select("stem", "importance").distinct().select("stem", F.lit(1).alias("query_id"), F.lit(1.0).alias("score"), F.col("importance").alias("confidence"))
    return fu.composite_score(rows).select("stem", F.round("composite", 6).alias("composite")).orderBy(F.desc("composite"), "stem").limit(10)


@query("snk5_front_matter", MEM + """SELECT project, '---' || chr(10) || 'project: ' || project || chr(10) || 'importance: ' || CAST(CAST(max(importance) AS DECIMAL(3, 1)) AS VARCHAR) || chr(10) || 'entries: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) || '# ' || project || chr(10) || string_agg('- ' || stem, chr(10) ORDER BY stem) AS body FROM mem GROUP BY 1""")
def snk5b(spark, sf):
    entries = mem(spark, sf).select("project", "stem", F.col("stem").cast("string").alias("entry"), F.col("importance").alias("confidence"))
    return sk.with_front_matter(sk.discovery_documents(entries, "stem"), entries).select("project", "body")


@query("snk4_audit_rows", "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'export_allowed' ELSE 'export_denied' END AS event_type FROM documents")
def snk4b(spark, sf):
    from engram.operators.filters import LEVELS, export_decisions, export_matrix
    from engram.plans.streams import folder

    d = table(spark, sf, "documents").withColumn("level", F.get(F.array(*[F.lit(x) for x in LEVELS]), (F.col("doc_id") % 4).cast("int")))
    decided = export_decisions(d.select("doc_id", "level", F.lit("csv").alias("format"), F.lit(None).cast("string").alias("token")), export_matrix(spark))
    return sk.export(d.select("doc_id", "level"), decided, "doc_id", folder(spark), "csv").select("doc_id", "event_type")


@query("src15_table_chunks", """WITH r AS (SELECT n_regionkey AS sheet, n_nationkey AS k, concat_ws(' | ', nullif(trim(n_name), ''), n_regionkey) AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT sheet, (i - 1) // 2 AS chunk, any_value(h) AS heading, string_agg(line, chr(10) ORDER BY i) AS text FROM r JOIN (SELECT sheet, line AS h FROM r WHERE i = 0) USING (sheet) WHERE i > 0 GROUP BY 1, 2""")
def src15b(spark, sf):
    n = table(spark, sf, "nation")
    return so.table_chunks(n, "n_regionkey", "n_nationkey", ["n_name", "n_regionkey"], 2).select(F.col("n_regionkey").alias("sheet"), "chunk", "heading", "text")

