"""Queries of scans, parsers, exports, sinks and extension points. Their inputs (notes with front matter, JSON exports, permission lists) are built from
the driver's tables by Spark; the SQL builds the same texts and parses them by its own means."""

from __future__ import annotations

import base64
import gzip
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions import hooks, payload
from engram.functions import text as tx
from engram.operators import filters as fl
from engram.operators import fusion as fu
from engram.operators.joins import shared_folder
from engram.plans.registry import query, table
from engram.plans.text import docs
from engram.sources import notes, sinks

#: documents as notes; some keys are absent, quoted, out of range or malformed.
NOTE = r"""WITH note AS (SELECT doc_id, '---' || chr(10) || 'project: ' || lang || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'sub_scope: "' || source || '"' || chr(10) END || 'type: decision' || chr(10)
|| CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'importance: nan' || chr(10) WHEN 2 THEN 'importance: 7' || chr(10) ELSE 'importance: 0.25' || chr(10) END || 'salience: ' || CAST(doc_id % 8 AS VARCHAR) || chr(10)
|| 'valid_from: ' || CASE WHEN doc_id % 5 = 0 THEN 'someday' ELSE '2024-03-0' || CAST(doc_id % 5 AS VARCHAR) END || chr(10) || 'date: ' || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '2024-02-0' || CAST(doc_id % 7 AS VARCHAR) END || chr(10)
|| 'tags: [' || lang || ', "' || source || '"]' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'acl_allow: [ann, "bob"]' || chr(10) WHEN 2 THEN 'acl_allow:' || chr(10) || '  - ann' || chr(10) || '  - ' || lang || chr(10) ELSE 'acl_allow: team' || chr(10) END
|| CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'classification: Secret' || chr(10) ELSE 'classification: Confidential' || chr(10) END || '---' || chr(10) || text AS content, text FROM documents),
f AS (SELECT *, regexp_extract(content, '^---[ \t]*\n(.*?)\n---', 1, 's') AS fm FROM note),
k AS (SELECT *, nullif(trim(regexp_extract(fm, '(?m)^project:[ \t]*(.*)$', 1), ' "'), '') AS project, nullif(trim(regexp_extract(fm, '(?m)^sub_scope:[ \t]*(.*)$', 1), ' "'), '') AS sub_scope, nullif(regexp_extract(fm, '(?m)^importance:[ \t]*(.*)$', 1), '') AS importance,
regexp_extract(fm, '(?m)^salience:[ \t]*(.*)$', 1) AS salience, regexp_extract(fm, '(?m)^valid_from:[ \t]*(.*)$', 1) AS valid_from, regexp_extract(fm, '(?m)^date:[ \t]*(.*)$', 1) AS date, regexp_extract(fm, '(?m)^tags:[ \t]*(.*)$', 1) AS tags,
regexp_extract(fm, '(?m)^acl_allow:[ \t]*(.*)$', 1) AS acl, regexp_extract_all(fm, '(?m)^[ \t]+-[ \t]*(.*)$', 1) AS acls, coalesce(nullif(lower(regexp_extract(fm, '(?m)^classification:[ \t]*(.*)$', 1)), ''), 'internal') AS level FROM f)
"""


def note_rows(spark, sf):
    m, nl = F.col("doc_id"), F.lit("\n")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], nl)
    none = F.lit("")
    content = F.concat(
        line("---"), line("project: ", F.col("lang")), F.when(m % 3 == 0, none).otherwise(line('sub_scope: "', F.col("source"), '"')), line("type: decision"),
        F.when(m % 4 == 0, none).when(m % 4 == 1, line("importance: nan")).when(m % 4 == 2, line("importance: 7")).otherwise(line("importance: 0.25")), line("salience: ", (m % 8).cast("string")),
        line("valid_from: ", F.when(m % 5 == 0, "someday").otherwise(F.concat(F.lit("2024-03-0"), (m % 5).cast("string")))), line("date: ", F.when(m % 7 == 0, "x").otherwise(F.concat(F.lit("2024-02-0"), (m % 7).cast("string")))),
        line("tags: [", F.col("lang"), ', "', F.col("source"), '"]'),
        F.when(m % 4 == 0, none).when(m % 4 == 1, line('acl_allow: [ann, "bob"]')).when(m % 4 == 2, line("acl_allow:\n  - ann\n  - ", F.col("lang"))).otherwise(line("acl_allow: team")),
        F.when(m % 6 == 0, none).when(m % 6 == 1, line("classification: Secret")).otherwise(line("classification: Confidential")), line("---"), F.col("text"),
    )
    return docs(spark, sf).select("doc_id", "source", content.alias("content"))


@query("src1_scan_notes", "SELECT source, doc_id FROM documents WHERE trim(text) <> '' AND doc_id % 50 <> 7 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5")
def src1(spark, sf):
    name = F.when(F.col("doc_id") % 50 == 7, "README.md").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    files = docs(spark, sf).select("source", "doc_id", F.concat(F.lit("notes/"), name).alias("path"), F.timestamp_seconds("doc_id").alias("mtime"), F.col("text").alias("content"))
    return notes.choose_notes(files, 5).select("source", "doc_id")


@query("src2_front_matter", NOTE + "SELECT doc_id, project, sub_scope, 'decision' AS type, strftime(try_cast(valid_from AS DATE), '%Y-%m-%d') AS valid_from FROM k")
def src2(spark, sf):
    rows = note_rows(spark, sf).select("doc_id", notes.front_matter(F.col("content")).alias("f"))
    return rows.select("doc_id", "f.project", "f.sub_scope", "f.type", F.date_format("f.valid_from", "yyyy-MM-dd").alias("valid_from"))


@query("src3_memory_score", NOTE + "SELECT doc_id, CASE WHEN importance IS NULL OR importance = 'nan' THEN 0.5 ELSE least(greatest(CAST(importance AS DOUBLE), 0), 1) END AS importance, least(greatest(CAST(salience AS DOUBLE), 0), 5) AS salience FROM k")
def src3(spark, sf):
    return note_rows(spark, sf).select("doc_id", notes.memory_score(F.col("content")).alias("s")).select("doc_id", "s.importance", "s.salience")


@query("src4_acl_front_matter", NOTE + r"""SELECT doc_id, CASE WHEN acl LIKE '[%' THEN array_to_string(list_transform(string_split(trim(acl, '[]'), ','), lambda x: trim(x, ' "')), ',') WHEN len(acls) > 0 THEN array_to_string(acls, ',') WHEN acl <> '' THEN acl END AS acl, level AS classification,
CASE WHEN level NOT IN ('public', 'internal', 'confidential', 'restricted') THEN 'unknown classification ' || level END AS error FROM k""")
def src4(spark, sf):
    rows = note_rows(spark, sf).select("doc_id", notes.acl_front_matter(F.col("content")).alias("a"))
    return rows.select("doc_id", F.array_join("a.acl_allow", ",").alias("acl"), "a.classification", "a.error")


@query("src5_discovery_records", NOTE + r"""SELECT doc_id, strftime(coalesce(try_cast(date AS DATE), DATE '2024-05-01'), '%Y-%m-%d') AS date, array_to_string(list_transform(string_split(trim(tags, '[]'), ','), lambda x: trim(x, ' "')), ',') AS tags,
left(trim(text, E' \t\n\r\f\x0b'), 300) AS preview, CAST(strlen(content) AS INTEGER) AS size FROM k""")
def src5(spark, sf):
    rows = notes.discovery_record(note_rows(spark, sf).withColumn("file_stem", F.concat(F.lit("2024-05-01-"), F.col("doc_id").cast("string"))))
    return rows.select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.array_join("tags", ",").alias("tags"), "preview", "size")


@query("src7_read_jsonl", "SELECT doc_id, lang, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS skipped FROM documents WHERE doc_id % 10 <> 0")
def src7(spark, sf):
    path = shared_folder(spark, "lines")
    good = F.to_json(F.struct("doc_id", "lang"))
    docs(spark, sf).select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("{"), good)).otherwise(good).alias("value")).write.text(path)
    rows, skipped = notes.read_jsonl(spark, path, T.StructType().add("doc_id", "long").add("lang", "string"))
    return rows.crossJoin(F.broadcast(skipped))


TURNS = "SELECT CAST(conv_id AS VARCHAR) AS conversation, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, trim(text, E' \\t\\n\\r\\f\\x0b') AS content FROM conversations WHERE trim(text, E' \\t\\n\\r\\f\\x0b') <> ''"


def turns(spark, sf):
    """One row for each conversation: its turns in order."""
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))


def said(df):
    return df.select("conversation", F.col("i").cast("long").alias("i"), "role", "content")


@query("src9_mapping_export", TURNS.replace("CAST(conv_id AS VARCHAR)", "CAST(conv_id AS VARCHAR) || '/0'").replace("WHERE", "WHERE role IN ('user', 'assistant') AND"))
def src9(spark, sf):
    node = lambda t: F.struct(t["turn"].cast("string"), F.struct(F.struct(F.struct(t["role"].alias("role")).alias("author"), F.struct(F.array(t["text"]).alias("parts")).alias("content"), t["turn"].cast("double").alias("create_time")).alias("message")))
    rows = turns(spark, sf).select(F.col("conv_id").alias("conversation"), F.to_json(F.array(F.struct(F.lit("t").alias("title"), F.map_from_entries(F.transform("t", node)).alias("mapping")))).alias("json"))
    return said(notes.mapping_export(rows))


@query("src10_turn_pairs", TURNS.replace("row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1", "2 * (turn // 2) + turn % 2").replace("role,", "CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,"))
def src10(spark, sf):
    at = lambda k: F.element_at(F.transform(F.filter("t", lambda t: t["turn"] == k), lambda t: t["text"]), 1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.array_max(F.transform("t", lambda t: t["turn"])) / 2).cast("int")), lambda k: F.struct(F.element_at(F.transform(F.filter("t", lambda t: t["turn"] == 2 * k), lambda t: t["text"]), 1).alias("human"), F.try_element_at(F.transform(F.filter("t", lambda t: t["turn"] == 2 * k + 1), lambda t: t["text"]), F.lit(1)).alias("model")))
    rows = turns(spark, sf).select(F.col("conv_id").cast("string").alias("conversation"), F.when(F.col("conv_id") % 2 == 0, F.to_json(pairs)).otherwise(F.to_json(F.struct(pairs.alias("conversations")))).alias("json"))
    return said(notes.turn_pair_export(rows))


def layered(spark, sf):
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    m = F.col("conv_id") % 3
    json = F.when(m == 0, F.to_json(F.struct(F.array(F.struct(messages.alias("messages"))).alias("conversations")))).when(m == 1, F.to_json(F.struct(messages.alias("messages")))).otherwise(F.to_json(messages))
    return turns(spark, sf).select(F.col("conv_id").cast("string").alias("conversation"), json.alias("json"))


@query("src11_layered_export", TURNS)
def src11(spark, sf):
    return said(notes.layered_export(layered(spark, sf)))


@query("ud3_parser_registry", TURNS)
def ud3(spark, sf):
    rows = layered(spark, sf)
    odd = F.col("conversation").cast("long") % 2 == 1
    return said(hooks.parse(rows.where(odd), "deepseek")).unionByName(hooks.parse(rows.where(~odd), "application/json").select("conversation", F.col("turn").alias("i"), "role", "content"))


@query("src17_backlog", r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS s FROM (SELECT doc_id, string_split('# ' || lang || chr(10) || 'plain' || chr(10) || '- [ ] early' || chr(10) || '## ' || source || chr(10) || '- [x] ' || CAST(doc_id AS VARCHAR) || chr(10) || '## two' || chr(10) || '  - [ ] late', chr(10)) AS p FROM documents)),
k AS (SELECT *, CASE WHEN s LIKE '# %' THEN 'epic' WHEN s LIKE '## %' THEN 'story' WHEN regexp_matches(s, '^\s*- \[') THEN 'task' END AS kind, regexp_replace(s, '^(#+|\s*- \[.\])\s*', '') AS title FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, kind, title, CASE kind WHEN 'story' THEN e WHEN 'task' THEN coalesce(t, e) END AS parent, s LIKE '%[x]%' AS done FROM (SELECT *, last_value(CASE WHEN kind = 'epic' THEN title END IGNORE NULLS) OVER w AS e, last_value(CASE WHEN kind = 'story' THEN title END IGNORE NULLS) OVER w AS t FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE kind IS NOT NULL""")
def src17(spark, sf):
    text = F.concat(F.lit("# "), F.col("lang"), F.lit("\nplain\n- [ ] early\n## "), F.col("source"), F.lit("\n- [x] "), F.col("doc_id").cast("string"), F.lit("\n## two\n  - [ ] late"))
    return notes.parse_backlog(docs(spark, sf).select("doc_id", text.alias("content")), "doc_id", "content")


@query("src19_permission_principals", "SELECT p_partkey AS item, unnest(CASE p_partkey % 3 WHEN 0 THEN ['u' || p_brand] WHEN 1 THEN ['g' || p_brand, 'g' || p_type] ELSE ['u' || p_type] END) AS principal FROM part WHERE p_size % 4 <> 0")
def src19(spark, sf):
    user = lambda c: F.struct(F.struct(F.concat(F.lit("u"), c).alias("id")).alias("user"))
    group = lambda c: F.struct(F.struct(F.concat(F.lit("g"), c).alias("id")).alias("group"))
    m = F.col("p_partkey") % 3
    grant = F.struct(
        F.array(F.when(F.col("p_size") % 4 == 0, "view").when(F.col("p_size") % 4 == 1, "read").when(F.col("p_size") % 4 == 2, "write").otherwise("owner")).alias("roles"),
        F.when(m == 0, user(F.col("p_brand"))).alias("grantedToV2"), F.when(m == 1, F.array(group(F.col("p_brand")), group(F.col("p_type")))).alias("grantedToIdentitiesV2"), F.when(m != 1, user(F.col("p_type"))).alias("grantedTo"),
    )
    return notes.permission_principals(table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.to_json(F.array(grant)).alias("json")))


@query("snk1_metric_lines", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def snk1(spark, sf):
    path = shared_folder(spark, "metrics")
    rows = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), "event_id", "value")
    for half in (0, 1):  # two appends to the same days
        sinks.append_lines(rows.where(F.col("event_id") % 2 == half), path)
    back = spark.read.json(path, schema="timestamp string, event_id long, value double, date date")
    return back.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@F.pandas_udf(T.StringType())
def _gzipped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode())


@query("tx27_payloads", "SELECT doc_id, 'src/' || source || '.py' AS path, sha256(text) AS diff FROM documents WHERE doc_id % 3 <> 0 AND strlen(text) <= 1048576")
def tx27(spark, sf):
    files = F.create_map(F.concat(F.lit("src/"), F.col("source"), F.lit(".py")), F.when(F.col("doc_id") % 3 == 0, "!!").otherwise(_gzipped(F.col("text"))), F.lit("deep/.env"), F.lit("!!"))
    rows = docs(spark, sf).select(F.col("doc_id").alias("checkpoint_id"), F.col("lang").alias("project_slug"), F.col("doc_id").alias("created_at"), files.alias("diffs"))
    return payload.file_diffs(rows, None).select(F.col("checkpoint_id").alias("doc_id"), "path", F.sha2("diff", 256).alias("diff"))


NEG = r"(^|[^\p{L}\p{N}_])(not|never|no|isn''t|aren''t|doesn''t|don''t|won''t|cannot|can''t)($|[^\p{L}\p{N}_])"


@query("tx19_negation", rf"SELECT doc_id, regexp_matches(lower(text), '{NEG}') AS negates, len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '{NEG}', '\1\3', 'g'), '{NEG}', '\1\3', 'g'), '\s+'), lambda x: x <> ''))) AS words FROM documents")
def tx19(spark, sf):
    return docs(spark, sf).select("doc_id", tx.has_negation(F.col("text")).alias("negates"), F.size(tx.word_set(tx.without_negations(F.col("text")))).cast("long").alias("words"))


@query("ud1_embeddings")
def ud1(spark, sf):
    return docs(spark, sf).select("doc_id", hooks.embedder(hooks.hashing_embedding(16))(F.col("text")).alias("embedding"))


@query("ud2_chunk_strategy", "SELECT doc_id, CAST(i AS INTEGER) AS i, trim(substr(text, CAST(i * 3200 + 1 AS BIGINT), 4000), E' \\t\\n\\r\\f\\x0b') AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 4000) / 3200), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)")
def ud2(spark, sf):
    return hooks.chunk(docs(spark, sf).select("doc_id", "text"), "fixed")


@query("ud4_rerank_function", "WITH p AS (SELECT conv_id AS query_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text FROM conversations) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) % 17 DESC, rank) AS new_rank FROM p QUALIFY new_rank <= 3")
def ud4(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.lit("").alias("query"), F.col("text").alias("content"), (-F.col("turn")).alias("score"))
    return hooks.rerank_with(fu.ranked(c), lambda q, t: (t.str.len() % 17).astype(float), 3).select("query_id", "id", "new_rank")


@query("ud5_alert_sink", "SELECT event_id FROM events WHERE event_type = 'error'")
def ud5(spark, sf):
    path = shared_folder(spark, "alerts")
    sink = hooks.alert_sink(lambda rows: rows.write.mode("append").parquet(path))
    alerts = table(spark, sf, "events").where("event_type = 'error'").select("event_id")
    for batch in (0, 1):
        sink(alerts.where(F.col("event_id") % 2 == batch), batch)
    return spark.read.schema("event_id long").parquet(path)


@query("ud6_acl_resolver", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 < 2")
def ud6(spark, sf):
    d = docs(spark, sf)
    acls = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 < 2, F.array(F.lit("ann"), "lang")).when(F.col("doc_id") % 5 == 2, F.array("lang")).alias("acl_allow"))
    return hooks.with_acl(d.select(F.col("doc_id").alias("id")), acls, ["ann", "zoe"])


@query("ud7_acl_intersection", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN '' END AS acl FROM customer")
def ud7(spark, sf):
    m = F.col("c_custkey") % 3
    acls = F.when(m == 0, F.array(F.array("c_mktsegment", F.lit("x")), F.array(F.lit("y"), "c_mktsegment"))).when(m == 1, F.array(F.array("c_mktsegment"), F.lit(None).cast("array<string>")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(hooks.acl_intersection(acls), ",").alias("acl"))


@query("so1_topk", "SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) AS rank FROM events QUALIFY rank <= 3")
def so1(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return fu.top_k(e, 3).select("query_id", "id", "rank")


@query("jn15_incremental_ingest", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN sha256(text) <> sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) THEN 'changed' ELSE 'same' END AS state, CASE lower(CASE doc_id % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'Secret' ELSE source END) WHEN 'public' THEN 'public' WHEN 'secret' THEN 'restricted' ELSE 'internal' END AS classification FROM documents)
SELECT doc_id, state, classification, CASE WHEN classification = 'restricted' THEN 'ceiling_exceeded' ELSE 'admitted' END AS reason FROM d WHERE state <> 'same'""")
def jn15(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.when(F.col("doc_id") % 4 == 0, "PUBLIC").when(F.col("doc_id") % 4 == 1, "Secret").otherwise(F.col("source")).alias("label"))
    index = d.where("doc_id % 10 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("sha256"))
    labels = spark.createDataFrame([("public", "public"), ("secret", "restricted")], "label string, classification string")
    new = notes.changed_files(index, d).select("doc_id", "state", "label")
    return notes.classify_labels(new, labels, "internal").select("doc_id", "state", "classification", fl.admission(F.col("classification"), "confidential", F.array(F.lit("ann")), ["ann"]).alias("reason"))


@query("fl13_session_events", "SELECT event_id, total FROM (SELECT event_id, count(*) OVER () AS total, row_number() OVER (ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-06') WHERE r > 40 AND r <= 140")
def fl13(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("mode"), F.col("ts").alias("timestamp"))
    return fl.session_events(rows, "view", F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz"), 40, 100).select("event_id", "total")
