"""Filter, access, join and graph queries over documents, events, orders, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import filters as fl
from engram.operators import graph as gr
from engram.operators import joins as jn
from engram.operators.joins import shared_folder
from engram.plans.registry import query, table

#: documents as records: ACLs of zero to two principals (null for one in five), a level, a project, a confidence.
REC = """WITH rec AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS project, source AS room, CASE WHEN doc_id % 6 = 0 THEN 'ambient_trace' WHEN doc_id % 6 = 1 THEN NULL ELSE 'decision' END AS type,
CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['ann'] WHEN 3 THEN ['ann', 'bob'] ELSE ['team'] END AS acl, ['public', 'internal', 'confidential', 'restricted', 'odd'][1 + doc_id % 5] AS level, (doc_id % 10) / 10 AS confidence, text FROM documents)
"""


def rec(spark, sf):
    d = table(spark, sf, "documents")
    m = F.col("doc_id")
    acl = F.when(m % 5 == 0, None).when(m % 5 == 1, F.array().cast("array<string>")).when(m % 5 == 2, F.array(F.lit("ann"))).when(m % 5 == 3, F.array(F.lit("ann"), F.lit("bob"))).otherwise(F.array(F.lit("team")))
    level = F.get(F.array(*[F.lit(x) for x in (*fl.LEVELS, "odd")]), (m % 5).cast("int"))
    kind = F.when(m % 6 == 0, "ambient_trace").when(m % 6 == 1, None).otherwise("decision")
    return d.select(m.alias("id"), F.when(m % 9 != 0, F.col("lang")).alias("project"), F.col("source").alias("room"), kind.alias("type"), acl.alias("acl"), level.alias("level"), ((m % 10) / 10).alias("confidence"), "text")


@query("fl1_project_filter", REC + "SELECT id FROM rec WHERE project IS NULL OR project IN ('en', 'fr')")
def fl1(spark, sf):
    return rec(spark, sf).where(fl.in_project(F.col("project"), "en", ("fr",))).select("id")


@query("fl2_room_filter", REC + "SELECT id FROM rec WHERE room IS NULL OR trim(room) = 'src3'")
def fl2(spark, sf):
    return rec(spark, sf).where(fl.in_room(F.col("room"), "src3 ")).select("id")


@query("fl3_no_ambient", REC + "SELECT id FROM rec WHERE type IS DISTINCT FROM 'ambient_trace'")
def fl3(spark, sf):
    return rec(spark, sf).where(fl.not_ambient(F.col("type"))).select("id")


@query("fl4_valid_at", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1997-06-01' AND (l_shipdate >= TIMESTAMP '1997-06-01' OR l_linenumber % 4 = 0)")
def fl4(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    until = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_shipdate"))
    return rows.where(fl.valid_at(F.col("o_orderdate"), until, F.lit("1997-06-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query("fl5_acl_closed", REC + "SELECT id FROM rec WHERE coalesce(list_has_any(acl, ['ann', 'team']), false)")
def fl5(spark, sf):
    return rec(spark, sf).where(fl.acl_closed(F.col("acl"), ["ann", "team"])).select("id")


@query("fl6_acl_open", REC + "SELECT id, acl IS NULL OR list_has_any(acl, ['bob']) AS shown FROM rec")
def fl6(spark, sf):
    raw = F.when(F.size("acl") == 1, F.col("acl")[0]).otherwise(F.to_json("acl"))
    parsed = rec(spark, sf).withColumn("acl", fl.parse_acl(F.when(F.col("acl").isNotNull(), raw)))
    return parsed.select("id", fl.acl_open(F.col("acl"), ["bob"]).alias("shown"))


@query("fl7_acl_graph", REC + "SELECT id FROM rec WHERE acl IS NULL OR list_has_any(acl, ['bob'])")
def fl7(spark, sf):
    return rec(spark, sf).where(fl.acl_graph(F.col("acl"), ["bob"])).select("id")


@query("fl8_admission", REC + "SELECT id, CASE WHEN NOT coalesce(list_has_any(acl, ['ann', 'team']), false) THEN 'acl_denied' WHEN level NOT IN ('public', 'internal', 'confidential') THEN 'ceiling_exceeded' ELSE 'admitted' END AS reason FROM rec")
def fl8(spark, sf):
    return rec(spark, sf).select("id", fl.admission(F.col("level"), "confidential", F.col("acl"), ["ann", "team"]).alias("reason"))


@query("fl9_export_policy", REC + """, r AS (SELECT id, level, ['json', 'csv', 'md'][1 + id % 3] AS format, CASE WHEN id % 2 = 0 THEN 't' END AS token FROM rec)
SELECT id, CASE WHEN level = 'odd' THEN 'unknown_level' WHEN level IN ('confidential', 'restricted') AND token IS NULL THEN 'approval_required' WHEN (level = 'confidential' AND format = 'md') OR (level = 'restricted' AND format <> 'json') THEN 'format_denied' ELSE 'allowed' END AS reason,
level IN ('confidential', 'restricted') AND token IS NOT NULL AND NOT ((level = 'confidential' AND format = 'md') OR (level = 'restricted' AND format <> 'json')) AS watermark FROM r""")
def fl9(spark, sf):
    fmt = F.get(F.array(F.lit("json"), F.lit("csv"), F.lit("md")), (F.col("id") % 3).cast("int"))
    req = rec(spark, sf).select("id", "level", fmt.alias("format"), F.when(F.col("id") % 2 == 0, "t").alias("token"))
    return fl.export_decisions(req, fl.export_matrix(spark)).select("id", "reason", "watermark")


@query("fl10_access_decisions", REC + """, r AS (SELECT id, acl, level, CASE WHEN id % 3 = 0 THEN 'owner' WHEN id % 3 = 1 THEN 'reader' ELSE 'ghost' END AS role, CASE WHEN id % 2 = 0 THEN 'staff' ELSE 'guest' END AS cr FROM rec)
SELECT id, CASE WHEN role = 'ghost' THEN 'no_capability' WHEN NOT coalesce(list_contains(acl, 'ann'), false) AND role <> 'owner' THEN 'not_in_acl' WHEN NOT (level = 'public' OR (level IN ('internal', 'confidential') AND cr = 'staff')) THEN 'class_denied' ELSE 'allowed' END AS reason FROM r""")
def fl10(spark, sf):
    r = rec(spark, sf).select("id", "acl", "level", F.lit("ann").alias("principal"), F.lit("read").alias("capability"), F.when(F.col("id") % 3 == 0, "owner").when(F.col("id") % 3 == 1, "reader").otherwise("ghost").alias("role"), F.when(F.col("id") % 2 == 0, "staff").otherwise("guest").alias("class_role"))
    caps = spark.createDataFrame([("owner", "read"), ("owner", "read_all"), ("reader", "read")], "role string, capability string")
    roles = spark.createDataFrame([("public", "staff"), ("public", "guest"), ("internal", "staff"), ("confidential", "staff")], "level string, class_role string")
    return fl.access_decisions(r, caps, roles).select("id", "reason")


@query("fl12_discovery_query", REC + "SELECT id, count(*) OVER () AS total FROM rec WHERE coalesce(list_has_any(acl, ['ann']), false) AND list_has_all([project, room, level], ['en', 'confidential']) ORDER BY id LIMIT 20 OFFSET 5")
def fl12(spark, sf):
    rows = rec(spark, sf).where(fl.acl_closed(F.col("acl"), ["ann"]) & fl.all_of(F.array("project", "room", "level"), ["en", "confidential"]))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("id").offset(5).limit(20).select("id").crossJoin(F.broadcast(total))


@query("fl14_memory_query", REC + "SELECT id FROM rec WHERE project = 'en' AND type = 'decision' AND id % 7 <> 0 ORDER BY id DESC LIMIT 200")
def fl14(spark, sf):
    return rec(spark, sf).where("project = 'en' AND type = 'decision' AND id % 7 <> 0").orderBy(F.desc("id")).limit(200).select("id")


@query("fl17_checkpoint_ttl", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN true ELSE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 400 DAY END AS kept FROM orders")
def fl17(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 10 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    limit = F.lit("1998-08-01").cast("timestamp") - F.expr("INTERVAL '400' DAY")
    return o.select("o_orderkey", F.coalesce(F.try_to_timestamp(raw) >= limit, F.lit(True)).alias("kept"))


@query("fl18_lease_validity", "SELECT event_id, ts + CASE event_id % 4 WHEN 2 THEN INTERVAL 48 HOUR WHEN 3 THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END > TIMESTAMP '2024-01-10' AS valid FROM events")
def fl18(spark, sf):
    e = table(spark, sf, "events").withColumn("level", F.get(F.array(*[F.lit(x) for x in fl.LEVELS]), (F.col("event_id") % 4).cast("int")))
    return e.select("event_id", (fl.lease_expiry(F.col("level"), F.col("ts")) > F.lit("2024-01-10").cast("timestamp_ntz")).alias("valid"))


#: Paths of many kinds, made of the documents' words and labels.
PATHS = """WITH p AS (SELECT doc_id, [source || '/' || lang || '.py', 'home/.ssh/' || lang, source || '/.env', source || '/.env.' || lang, 'keys/' || lang || '.pem', 'a/.aws/' || source, lang || '/id_rsa', source || '/environment.md', 'secrets/' || lang || '.txt', source || '/x.KEY'][1 + doc_id % 10] AS path FROM documents)"""


@query("fl19_secret_paths", PATHS + """, q AS (SELECT doc_id, path, string_split(path, '/')[:-2] AS dirs, string_split(path, '/')[-1] AS base FROM p)
SELECT doc_id, path, len(list_filter(dirs, lambda x: lower(x) IN ('.ssh', '.aws', '.gnupg', 'secrets'))) > 0 OR lower(base) = '.env' OR lower(base) LIKE '.env.%' OR lower(base) LIKE 'id!_rsa%' ESCAPE '!' OR lower(base) LIKE '%.pem' OR lower(base) LIKE '%.key' OR lower(base) LIKE 'credentials%' AS secret FROM q""")
def fl19(spark, sf):
    lang, source = F.col("lang"), F.col("source")
    kinds = F.array(F.concat(source, F.lit("/"), lang, F.lit(".py")), F.concat(F.lit("home/.ssh/"), lang), F.concat(source, F.lit("/.env")), F.concat(source, F.lit("/.env."), lang), F.concat(F.lit("keys/"), lang, F.lit(".pem")), F.concat(F.lit("a/.aws/"), source), F.concat(lang, F.lit("/id_rsa")), F.concat(source, F.lit("/environment.md")), F.concat(F.lit("secrets/"), lang, F.lit(".txt")), F.concat(source, F.lit("/x.KEY")))
    d = table(spark, sf, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % 10).cast("int")).alias("path"))
    return d.select("doc_id", "path", fl.is_secret_path(F.col("path")).alias("secret"))


@query("fl20_admission_gate", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN len(w) <= 20 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(1.0::DOUBLE, len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) / 0.2::DOUBLE)) END AS r FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]{2,}') AS w FROM documents)) WHERE r >= 0.9")
def fl20(spark, sf):
    return table(spark, sf, "documents").where(tx.boilerplate(F.col("text")) * tx.richness(F.col("text")) >= 0.9).select("doc_id")


@query("fl21_project_scope", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ',x' WHEN doc_id % 3 = 1 THEN 'x' END AS scope FROM documents")
def fl21(spark, sf):
    groups = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("project:"), "lang"), F.lit("staff")))
    explicit = F.when(F.col("doc_id") % 3 != 2, F.array(F.lit("x")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(fl.project_scope(groups, explicit), ",").alias("scope"))


@query("fl22_row_validity", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'category' WHEN value <= 5 THEN 'value' END AS reject FROM events")
def fl22(spark, sf):
    e = table(spark, sf, "events").withColumn("category", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return fl.split_valid(e, {"category": F.col("category").isNotNull(), "value": F.col("value") > 5}).select("event_id", "reject")


@query("so3_union_sources", "SELECT source, count(*) AS n FROM (SELECT source, text FROM documents UNION ALL SELECT role, text FROM conversations) GROUP BY 1")
def so3(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("role").alias("source"), "text", "turn")
    return table(spark, sf, "documents").select("source", "text").unionByName(c, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


@query("so5_array_algebra", REC + "SELECT id, array_to_string(list_sort(list_intersect(acl, ['ann', 'team'])), ',') AS common, list_has_any(acl, ['bob']) AS any_of, list_has_all(acl, ['ann', 'bob']) AS all_of FROM rec WHERE acl IS NOT NULL")
def so5(spark, sf):
    both = F.array(F.lit("ann"), F.lit("team"))
    rows = rec(spark, sf).where("acl IS NOT NULL")
    return rows.select("id", F.array_join(F.array_sort(F.array_intersect("acl", both)), ",").alias("common"), F.arrays_overlap("acl", F.array(F.lit("bob"))).alias("any_of"), fl.all_of(F.col("acl"), ["ann", "bob"]).alias("all_of"))


# --- joins -------------------------------------------------------------------

WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))"


@query("jn1_near_duplicate_pairs", REC + f""", s AS (SELECT id, project, confidence, {WORDS} AS w FROM rec WHERE project IS NOT NULL), p AS (SELECT project, id, confidence, len(w) AS n, unnest(w) AS x FROM s),
c AS (SELECT a.id, b.id AS id2, any_value(a.confidence) AS ca, any_value(b.confidence) AS cb, count(*) / any_value(greatest(a.n, b.n)) AS sim FROM p a JOIN p b ON a.project = b.project AND a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT id, id2, round(sim, 6) AS similarity, CASE WHEN cb > ca THEN id2 ELSE id END AS winner FROM c WHERE sim >= 0.92""")
def jn1(spark, sf):
    return jn.near_duplicate_pairs(rec(spark, sf).where("project IS NOT NULL")).withColumn("similarity", F.round("similarity", 6))


@query("jn2_recent_duplicates", """WITH e AS (SELECT vec_id AS id, label % 4 AS project, vec_id AS ts, embedding::DOUBLE[] AS x FROM embeddings), o AS (SELECT * FROM e WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, id) <= 50)
SELECT e.id, o.id AS old_id, round(list_cosine_similarity(e.x, o.x), 6) AS similarity FROM e JOIN o USING (project) WHERE e.id % 2 = 1 AND list_cosine_similarity(e.x, o.x) >= 0.3""")
def jn2(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 4).alias("project"), F.col("vec_id").alias("ts"), "embedding")
    return jn.recent_duplicates(e.where("id % 2 = 1"), e.where("id % 2 = 0"), 50, 0.3).withColumn("similarity", F.round("similarity", 6))


NEG = r"(^|[^\p{L}\p{N}_])(not|never|no|isn''t|aren''t|doesn''t|don''t|won''t|cannot|can''t)($|[^\p{L}\p{N}_])"


@query("jn3_contradictions", rf"""WITH t AS (SELECT doc_id AS id, source AS project, (doc_id % 10) / 10 AS confidence, doc_id % 7 = 0 AS pinned, regexp_matches(lower(text), '{NEG}') AS neg,
list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '{NEG}', '\1\3', 'g'), '{NEG}', '\1\3', 'g'), '\s+'), lambda x: x <> '')) AS w FROM documents),
p AS (SELECT id, project, neg, confidence, len(w) AS n, unnest(w) AS x FROM t), c AS (SELECT a.id AS i, b.id AS j, count(*) / any_value(greatest(a.n, b.n)) AS o, any_value(least(a.confidence, b.confidence)) AS m FROM p a JOIN p b ON a.project = b.project AND a.x = b.x AND a.neg AND NOT b.neg GROUP BY ALL),
r AS (SELECT least(i, j) AS a, greatest(i, j) AS b, o, m FROM c WHERE o > 0.4)
SELECT a, b, round(o, 6) AS overlap, CASE WHEN m > 0.8 THEN 'high' ELSE 'medium' END AS severity, m >= 0.85 AS auto_emit, CASE WHEN a % 7 = 0 THEN a WHEN b % 7 = 0 THEN b END AS pinned_winner FROM r""")
def jn3(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.col("source").alias("project"), ((F.col("doc_id") % 10) / 10).alias("confidence"), (F.col("doc_id") % 7 == 0).alias("pinned"), "text")
    return jn.contradictions(rows).withColumn("overlap", F.round("overlap", 6))


SESS = r"""WITH ses AS (SELECT conv_id AS id, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id * 20 AS INTEGER)) AS ts, list_distinct(flatten(list(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_]{2,}'), lambda x: lower(x))))) AS v FROM conversations GROUP BY conv_id)
"""


def sessions(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(tx.session_tokens(F.col("text"))))).alias("vocabulary"))
    return c.select(F.col("conv_id").alias("id"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 72000).alias("ts"), "vocabulary")


LINKS = SESS + ", w AS (SELECT id, ts, unnest(v) AS x FROM ses), l AS (SELECT a.id AS source_id, b.id AS target_id, count(*) AS overlap, round(max(epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9, 3) AS delta_hours FROM w a JOIN w b ON a.x = b.x AND a.id > b.id AND a.ts - b.ts <= INTERVAL 168 HOUR GROUP BY ALL HAVING count(*) >= 5)"


def links(spark, sf):
    return jn.link_sessions(sessions(spark, sf))


@query("jn4_session_links", LINKS + " SELECT source_id, target_id, overlap, delta_hours, left(sha256(source_id || '' || target_id || 'PRECEDED_BY'), 12) AS edge_id FROM l")
def jn4(spark, sf):
    return links(spark, sf)


@query("jn5_co_work", "WITH s AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey % 50 AS e FROM orders) SELECT DISTINCT least(a.e, b.e) AS a, greatest(a.e, b.e) AS b FROM s a JOIN s b ON a.id < b.id AND a.e <> b.e AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 48 * 3600 * 1000000::BIGINT")
def jn5(spark, sf):
    o = table(spark, sf, "orders")
    return jn.co_work(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")), o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("entity")))


@query("jn6_co_occurrences", "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey % 100 AS p FROM lineitem) SELECT a.p AS a, b.p AS b, count(*) AS blocks FROM d a JOIN d b USING (l_orderkey) WHERE a.p < b.p GROUP BY ALL")
def jn6(spark, sf):
    return jn.co_occurrences(table(spark, sf, "lineitem").withColumn("p", F.col("l_partkey") % 100), "l_orderkey", "p")


@query("jn7_event_memories", "SELECT DISTINCT e.user_id, d.doc_id FROM events e JOIN documents d ON d.doc_id IN (CAST(e.props->>'$.k' AS BIGINT), CAST(e.props->>'$.k' AS BIGINT) + 100)")
def jn7(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    refs = table(spark, sf, "events").select("user_id", F.explode(F.array(k, k + 100)).alias("doc_id"))
    return refs.join(table(spark, sf, "documents").select("doc_id"), "doc_id").distinct()


@query("jn8_session_records", "WITH k AS (SELECT user_id, ts, CAST(props->>'$.k' AS BIGINT) AS k FROM events), m AS (SELECT doc_id AS k, lang FROM documents) SELECT user_id, array_to_string(list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))), ',') AS vocabulary, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM k LEFT JOIN m USING (k) GROUP BY 1")
def jn8(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    m = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "lang")
    return e.join(m, "k", "left").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("vocabulary"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("jn9_unlinked_sessions", LINKS + " SELECT id FROM ses WHERE id NOT IN (SELECT source_id FROM l UNION SELECT target_id FROM l)")
def jn9(spark, sf):
    e = links(spark, sf)
    ends = e.select(F.col("source_id").alias("id")).union(e.select(F.col("target_id").alias("id"))).distinct()
    return sessions(spark, sf).select("id").join(ends, "id", "left_anti")


@query("jn10_entity_priority", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'regex' ELSE 'model' END AS kind FROM part")
def jn10(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    both = p.withColumn("kind", F.lit("model")).withColumn("priority", F.lit(2)).union(p.where("id % 2 = 0").withColumn("kind", F.lit("regex")).withColumn("priority", F.lit(1)))
    return jn.by_priority(both, ["id"], "priority").drop("priority")


@query("jn11_delta_pull", REC + ", log AS (SELECT event_id AS cid, CAST(props->>'$.k' AS BIGINT) AS record_id, ts FROM events) SELECT rec.id AS record_id, max(cid) AS change_id FROM rec JOIN log ON log.record_id = rec.id WHERE ts > TIMESTAMP '2024-01-05' AND coalesce(list_contains(acl, 'ann'), false) GROUP BY 1")
def jn11(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("record_id"), F.col("ts").alias("changed_at"))
    r = rec(spark, sf).select(F.col("id").alias("record_id"), F.col("acl").alias("acl_allow"))
    return fl.delta_pull(r, log, F.lit("2024-01-05").cast("timestamp_ntz"), "ann").select("record_id", "change_id")


@query("jn12_delta_push", REC + """, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN ['ann'] ELSE acl END AS sacl, 'confidential' AS slevel FROM rec WHERE id % 3 <> 0), rk AS (SELECT * FROM (VALUES ('public', 0), ('internal', 1), ('confidential', 2), ('restricted', 3)) v(l, r))
SELECT id, CASE WHEN NOT coalesce(list_contains(acl, 'ann'), false) THEN 'not_in_acl' WHEN r IS NULL THEN 'unknown_class' WHEN len(list_filter(acl, lambda x: NOT list_contains(coalesce(sacl, acl), x))) > 0 THEN 'acl_widened' WHEN slevel IS NOT NULL AND r < 2 THEN 'class_loosened' ELSE 'accepted' END AS reason FROM rec LEFT JOIN s USING (id) LEFT JOIN rk ON l = level""")
def jn12(spark, sf):
    r = rec(spark, sf)
    server = r.where("id % 3 <> 0").select(F.col("id").alias("record_id"), F.when(F.col("id") % 4 == 0, F.array(F.lit("ann"))).otherwise(F.col("acl")).alias("acl_allow"), F.lit("confidential").alias("classification"))
    incoming = r.select(F.col("id").alias("record_id"), F.col("acl").alias("acl_allow"), F.col("level").alias("classification"))
    return fl.delta_push(incoming, server, "ann").select(F.col("record_id").alias("id"), "reason")


@query("jn14_recalled_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT CAST(props->>'$.k' AS BIGINT) FROM events WHERE event_type = 'view')")
def jn14(spark, sf):
    k = F.get_json_object("props", "$.k")
    seen = table(spark, sf, "events").where("event_type = 'view'").select(F.explode(F.array(F.concat(k, F.lit("#0")), F.concat(k, F.lit("#1")))).alias("chunk_id"))
    stems = seen.select(F.split("chunk_id", "#")[0].cast("long").alias("doc_id")).distinct()
    return table(spark, sf, "documents").select("doc_id").join(stems, "doc_id", "left_anti")


@query("wn13_first_wins", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def wn13(spark, sf):
    return jn.first_wins(table(spark, sf, "documents"), "text", "doc_id").select("doc_id")


@query("so4_distinct_texts", "SELECT count(DISTINCT text) AS texts, count(*) AS n FROM documents")
def so4(spark, sf):
    return table(spark, sf, "documents").agg(F.count_distinct("text").alias("texts"), F.count("*").alias("n"))


@query("ag13_source_weights", "SELECT source, round(greatest(0.1, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END)), 6) AS weight FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def ag13(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.round(F.greatest(F.lit(0.1), F.avg(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("double"))), 6).alias("weight"))


@query("ag17_entity_merge", """WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Node ' ELSE 'node_' END || CAST(c_custkey % 300 AS VARCHAR) AS name, c_mktsegment AS type, 'f' || CAST(c_custkey % 7 AS VARCHAR) AS f, (c_custkey % 10) / 10 AS conf, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ['a', 'b' || CAST(c_custkey % 2 AS VARCHAR)] END AS acl FROM customer),
k AS (SELECT regexp_replace(lower(trim(name)), '[\\s_-]+', '', 'g') AS k, * FROM e)
SELECT min(id) AS entity_id, arg_min(name, id) AS name, type, array_to_string(list_sort(list_distinct(list(f))), ',') AS files, max(conf) AS confidence, count(*) AS merged,
CASE WHEN count(acl) > 0 THEN array_to_string(list_filter(['a', 'b0', 'b1'], lambda x: list_contains(list_intersect(['a', 'b0', 'b1'], [x]), x) AND bool_and(coalesce(list_contains(acl, x), false))), ',') END AS acl FROM k GROUP BY k, type""".replace(
    "list_filter(['a', 'b0', 'b1'], lambda x: list_contains(list_intersect(['a', 'b0', 'b1'], [x]), x) AND bool_and(coalesce(list_contains(acl, x), false)))",
    "list_filter([CASE WHEN bool_and(coalesce(list_contains(acl, 'a'), false)) THEN 'a' END, CASE WHEN bool_and(coalesce(list_contains(acl, 'b0'), false)) THEN 'b0' END, CASE WHEN bool_and(coalesce(list_contains(acl, 'b1'), false)) THEN 'b1' END], lambda x: x IS NOT NULL)"))
def ag17(spark, sf):
    c, m = table(spark, sf, "customer"), F.col("c_custkey")
    e = c.select(m.alias("entity_id"), F.concat(F.when(m % 2 == 0, "Node ").otherwise("node_"), (m % 300).cast("string")).alias("name"), F.col("c_mktsegment").alias("type"), F.array(F.concat(F.lit("f"), (m % 7).cast("string"))).alias("source_files"), ((m % 10) / 10).alias("confidence"), m.alias("first_seen"), F.when(m % 4 != 0, F.array(F.lit("a"), F.concat(F.lit("b"), (m % 2).cast("string")))).alias("acl_allow"))
    out = jn.merge_entities(e)
    return out.select("entity_id", "name", "type", F.array_join("source_files", ",").alias("files"), "confidence", "merged", F.array_join("acl_allow", ",").alias("acl"))


@query("ag18_graph_status", LINKS + " SELECT (SELECT count(*) FROM ses) AS nodes, count(*) AS edges FROM l")
def ag18(spark, sf):
    return sessions(spark, sf).agg(F.count("*").alias("nodes")).crossJoin(links(spark, sf).agg(F.count("*").alias("edges")))


@query("ag19_state_counts", REC + "SELECT count(*) AS total, count(*) FILTER (type IS DISTINCT FROM 'ambient_trace') AS active, (SELECT count(*) FROM events) AS events FROM rec")
def ag19(spark, sf):
    return rec(spark, sf).agg(F.count("*").alias("total"), F.count_if(fl.not_ambient(F.col("type"))).alias("active")).crossJoin(table(spark, sf, "events").agg(F.count("*").alias("events")))


@query("ag23_memory_clusters", REC.replace("WITH rec", "WITH RECURSIVE rec") + f""", s AS (SELECT id, project, {WORDS} AS w FROM rec WHERE project IS NOT NULL), p AS (SELECT project, id, len(w) AS n, unnest(w) AS x FROM s),
l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.project = b.project AND a.x = b.x AND a.id <> b.id GROUP BY ALL HAVING count(*) / any_value(greatest(a.n, b.n)) >= 0.75),
r(id, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id) SELECT root AS cluster, count(*) AS size FROM (SELECT id, min(root) AS root FROM r GROUP BY 1) GROUP BY 1""")
def ag23(spark, sf):
    found = jn.near_duplicate_clusters(rec(spark, sf).where("project IS NOT NULL"), 0.75)
    return found.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")


JACCARD = REC.replace("WITH rec", "WITH RECURSIVE rec") + f""", s AS (SELECT id, project, epoch_us(TIMESTAMP '2024-01-01') + id * 5400000000 AS tm, text, {WORDS} AS w FROM rec WHERE project IS NOT NULL), p AS (SELECT project, id, tm, len(w) AS n, unnest(w) AS x FROM s),
l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.project = b.project AND a.x = b.x AND a.id <> b.id AND abs(a.tm - b.tm) <= 86400000000 GROUP BY ALL HAVING count(*) / (any_value(a.n + b.n) - count(*)) >= 0.75 - 1e-9),
r(id, root) AS (SELECT id, id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), c AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1),
m AS (SELECT s.project, c.cluster, s.id, s.tm, replace(left(s.text, 200), chr(10), ' ') AS snippet, row_number() OVER (PARTITION BY s.project, c.cluster ORDER BY s.tm DESC, s.id) AS r FROM s JOIN c USING (id)),
g AS (SELECT project, cluster, count(*) AS size, strftime(make_timestamp(min(tm)), '%Y-%m-%d %H:%M UTC') AS earliest, strftime(make_timestamp(max(tm)), '%Y-%m-%d %H:%M UTC') AS latest, string_agg(snippet, ' | ' ORDER BY r) FILTER (r <= 3) AS snippets, max(tm) AS last FROM m GROUP BY ALL)
"""


def scenarios(spark, sf):
    from engram.operators.scenarios import memory_clusters

    r = rec(spark, sf)
    return memory_clusters(r.select("id", "project", F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("id") * 5_400_000_000).alias("ts"), F.col("text").alias("content")))


@query("ag23_scenarios", JACCARD + "SELECT project, cluster, size, earliest, latest, 'Scene ' || earliest AS name, snippets, row_number() OVER (PARTITION BY project ORDER BY last DESC, cluster) - 1 AS place FROM g")
def ag23b(spark, sf):
    return scenarios(spark, sf).withColumn("snippets", F.array_join("snippets", " | "))


@query("rk32_scenario_summary", JACCARD + r""", bl AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY last DESC, cluster) - 1 AS position, 'Scene ' || earliest || E'\n\n*' || size || ' memories — latest: ' || latest || E'*\n' || (SELECT string_agg(E'\n- ' || snippet, '' ORDER BY r) FROM m WHERE m.project = g.project AND m.cluster = g.cluster AND m.r <= 3) || E'\n' AS content FROM g),
q AS (SELECT item_id AS query_id, ['de', 'en', 'es', 'fr'][1 + item_id % 4] AS project, CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS text FROM benchmark),
t AS (SELECT query_id, project, """ + WORDS + r""" AS w FROM q), f AS (SELECT query_id, project, position, content, len(list_filter(w, lambda x: contains(lower(content), x))) AS score FROM t JOIN bl USING (project)),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) = 1), z AS (SELECT *, string_split(trim(content, E' \t\n\r'), E'\n') AS ls FROM o)
SELECT query_id, project, position, score, CASE WHEN project = 'en' THEN E'Persona\n\n' ELSE '' END || '## ' || trim(ls[1], E' \t\n\r') || E'\n' || trim(array_to_string(ls[2:5], E'\n'), E' \t\n\r') AS summary FROM z""")
def rk32b(spark, sf):
    from engram.operators.scenarios import block_summaries, scenario_block

    b = scenarios(spark, sf).select("project", F.col("place").alias("position"), scenario_block().alias("content"))
    names = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.get(names, (F.col("item_id") % 4).cast("int")).alias("project"), F.when(F.col("item_id") % 5 != 0, F.col("text")).otherwise("").alias("text"))
    return block_summaries(b, q, spark.createDataFrame([("en", "Persona")], "project string, text string"))


# --- graph: nations and their suppliers and customers as nodes, links of sessions as edges ---

EDGE = LINKS + ", e AS (SELECT source_id AS a, target_id AS b, overlap, delta_hours FROM l UNION ALL SELECT target_id, source_id, overlap, delta_hours FROM l)"


def graph_edges(spark, sf):
    return links(spark, sf).withColumn("relationship", F.lit("PRECEDED_BY")).withColumn("valid_until", F.when(F.col("overlap") % 2 == 0, "2024-06-01").when(F.col("overlap") % 3 == 0, "broken"))


def nodes(spark, sf, *ids):
    return sessions(spark, sf).where(F.col("id").isin(*ids)).select(F.col("id").alias("node"))


@query("gr1_edges_of_node", EDGE + " SELECT a AS node, b, overlap FROM e WHERE a IN (3, 4) AND NOT (overlap % 2 = 0)")
def gr1(spark, sf):
    found = gr.edges_of(graph_edges(spark, sf), nodes(spark, sf, 3, 4), ["PRECEDED_BY"], F.lit("2024-07-01").cast("timestamp"))
    return found.select("node", "b", "overlap")


@query("gr2_invalidate", LINKS + " SELECT source_id, target_id, CASE WHEN source_id = 4 THEN '2024-02-01' WHEN overlap % 2 = 0 THEN '2024-06-01' WHEN overlap % 3 = 0 THEN 'broken' END AS valid_until FROM l")
def gr2(spark, sf):
    e = graph_edges(spark, sf)
    return gr.invalidate(e, e.where("source_id = 4").select("edge_id"), "2024-02-01").select("source_id", "target_id", "valid_until")


@query("gr3_k_hops", EDGE.replace("WITH ses", "WITH RECURSIVE ses") + ", t(origin, node, depth) AS (SELECT id, id, 0 FROM ses WHERE id % 5 = 0 AND id % 7 <> 6 UNION SELECT origin, b, depth + 1 FROM t JOIN e ON a = node WHERE depth < 3 AND overlap >= 8 AND b % 7 <> 6) SELECT origin, node, min(depth) AS depth FROM t GROUP BY 1, 2")
def gr3(spark, sf):
    ok = sessions(spark, sf).where("id % 7 <> 6").select(F.col("id").alias("node"))
    origins = sessions(spark, sf).where("id % 5 = 0").select(F.col("id").alias("node"))
    return gr.k_hops(graph_edges(spark, sf).where("overlap >= 8"), origins, 3, ["PRECEDED_BY"], ok)


HITS = EDGE + ", h AS (SELECT id % 10 AS query_id, id, 1.0 / (1 + id) AS score, row_number() OVER (PARTITION BY id % 10 ORDER BY id) AS rank FROM ses)"


def hits(spark, sf):
    from engram.operators.fusion import ranked

    return ranked(sessions(spark, sf).select((F.col("id") % 10).alias("query_id"), "id", (1.0 / (1 + F.col("id"))).alias("score")))


#: Words of the sessions' vocabularies as entities: the node is a session, its name its least word (every third written as a call), and a session's confidence cycles.
NAMED = EDGE + """, en AS (SELECT id AS node, list_min(v) AS name, CASE WHEN id % 5 = 0 THEN 0.6 ELSE 0.9 END AS confidence FROM ses WHERE list_min(v) IS NOT NULL), ok AS (SELECT * FROM en WHERE confidence >= 0.7),
qn AS (SELECT DISTINCT item_id AS query_id, text, node FROM benchmark JOIN ok ON regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || name || '($|[^\\p{L}\\p{N}_])')),
nb AS (SELECT query_id, ok.name AS term, min(struct_pack(node := qn.node, b := e.b)) AS o FROM qn JOIN e ON e.a = qn.node JOIN ok ON ok.node = e.b WHERE NOT contains(lower(text), ok.name) GROUP BY ALL),
ex AS (SELECT query_id, string_agg(term, ' ' ORDER BY o.node, o.b) AS x FROM nb GROUP BY 1)"""


@query("gr4_query_expansion", NAMED + " SELECT item_id AS query_id, text || coalesce(' ' || x, '') AS expanded FROM benchmark LEFT JOIN ex ON ex.query_id = item_id")
def gr4(spark, sf):
    word = F.array_min("vocabulary")
    named = sessions(spark, sf).where(word.isNotNull()).select(F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, F.concat(word, F.lit("()"))).otherwise(word).alias("name"), F.when(F.col("id") % 5 == 0, 0.6).otherwise(0.9).alias("confidence"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return gr.expand_queries(q, named, graph_edges(spark, sf))


@query("gr5_score_boost", HITS + ", m AS (SELECT id, id % 6 AS entity FROM ses), k AS (SELECT DISTINCT query_id, query_id % 6 AS entity, 0.5 + query_id / 4 AS weight FROM h) SELECT h.query_id, h.id, round(score + CASE WHEN weight IS NULL THEN 0 ELSE least(weight * 0.1, 0.3) END, 6) AS score FROM h JOIN m USING (id) LEFT JOIN k ON k.query_id = h.query_id AND k.entity = m.entity")
def gr5(spark, sf):
    h = hits(spark, sf)
    m = sessions(spark, sf).select("id", (F.col("id") % 6).alias("entity"))
    k = h.select("query_id", (F.col("query_id") % 6).alias("entity"), (0.5 + F.col("query_id") / 4).alias("weight")).distinct()
    return gr.score_boost(h, m, k).select("query_id", "id", F.round("score", 6).alias("score"))


@query("gr6_precedence_boost", HITS + ", n AS (SELECT DISTINCT query_id, b AS id FROM h JOIN e ON a = h.id WHERE rank <= 5), x AS (SELECT query_id, max(score) AS best FROM h GROUP BY 1), u AS (SELECT query_id, id, score FROM h UNION ALL SELECT query_id, id, best * 1.1 FROM n JOIN x USING (query_id)), g AS (SELECT query_id, id, max(score) AS score FROM u GROUP BY ALL) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM g")
def gr6(spark, sf):
    return gr.precedence_boost(hits(spark, sf), graph_edges(spark, sf)).withColumn("score", F.round("score", 6))


@query("gr7_agent_trail", "SELECT event_id FROM events WHERE user_id = 5 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' AND event_id % 4 = 1 ORDER BY ts, event_id")
def gr7(spark, sf):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = table(spark, sf, "events").where((F.col("user_id") == 5) & (F.col("ts") >= t("2024-01-02")) & (F.col("ts") < t("2024-01-20")) & (F.col("event_id") % 4 == 1))
    return rows.orderBy("ts", "event_id").select("event_id")


REFS = "WITH r AS (SELECT event_id, user_id AS agent, ts, CAST(props->>'$.k' AS BIGINT) AS memory FROM events)"


def refs(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("agent"), "ts", F.get_json_object("props", "$.k").cast("long").alias("memory"))


@query("gr8_observers", REFS + " SELECT memory, agent, event_id FROM r QUALIFY row_number() OVER (PARTITION BY memory, agent ORDER BY ts, event_id) = 1")
def gr8(spark, sf):
    return gr.observers(refs(spark, sf)).select("memory", "agent", "event_id")


@query("gr9_seed_bundle", REFS + """, s AS (SELECT memory, count(DISTINCT agent) AS o, max(ts) AS last FROM r WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1), n AS (SELECT doc_id AS memory, [lang, source] AS w FROM documents),
x AS (SELECT memory, len(list_intersect(w, ['en', 'src1', 'src2'])) / len(list_distinct(list_concat(w, ['en', 'src1', 'src2']))) * exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 8.64e10 / 7) * ln(2 + o) AS score FROM s JOIN n USING (memory))
SELECT memory, round(score, 6) AS score FROM x ORDER BY round(score, 9) DESC, memory LIMIT 20""")
def gr9(spark, sf):
    names = table(spark, sf, "documents").select(F.col("doc_id").alias("memory"), F.array("lang", "source").alias("words"))
    recent = refs(spark, sf).where(F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    return gr.seed_bundle(recent, names, ["en", "src1", "src2"], F.lit("2024-02-01").cast("timestamp_ntz"), 20).select("memory", F.round("score", 6).alias("score"))


@query("gr10_recent_events", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 4 = 2 ORDER BY ts DESC, event_id LIMIT 30")
def gr10(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error' AND user_id % 4 = 2").orderBy(F.desc("ts"), "event_id").limit(30).select("event_id")


@query("gr11_link_and_store", LINKS + """, i AS (SELECT id, left(sha256(CAST(id AS VARCHAR) || 'session' || 'p' || CAST(id % 3 AS VARCHAR)), 12) AS eid, 'p' || CAST(id % 3 AS VARCHAR) AS project FROM ses)
SELECT left(sha256(s.eid || t.eid || 'PRECEDED_BY'), 12) AS edge_id, s.eid AS source_id, t.eid AS target_id, s.project AS acl, overlap, (SELECT count(*) FROM ses) AS sessions, (SELECT count(*) FROM l) AS edges_added FROM l JOIN i s ON s.id = source_id JOIN i t ON t.id = target_id""")
def gr11(spark, sf):
    e, n = shared_folder(spark, "edges"), shared_folder(spark, "entities")
    ses = jn.stored(sessions(spark, sf).withColumn("project", F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))), "sessions")
    found = jn.stored(jn.link_sessions(ses), "links")  # three calls read both
    gr.link_and_store(ses, found, n, e, dry_run=True)
    for _ in range(2):  # storing again adds nothing
        done = gr.link_and_store(ses, found, n, e)
    return spark.read.parquet(e).select("edge_id", "source_id", "target_id", F.col("acl_allow")[0].alias("acl"), "overlap").crossJoin(F.broadcast(done.select("sessions", "edges_added")))


@query("gr12_publish", "SELECT left(sha256(event_type || CAST(user_id % 9 AS VARCHAR)), 12) AS memory_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS published, count(DISTINCT user_id) AS agents FROM events GROUP BY 1")
def gr12(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 9).cast("string")).alias("content"), F.col("user_id").alias("agent"), "ts")
    return gr.publish(e).withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))
