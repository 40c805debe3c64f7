"""Scans and parsers (SRC): notes with front matter, JSON lines, conversation exports, HTML, tabular rows, change feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions import text as tx

BLANK = " \t\n\r\f\x0b"


def scan_notes(spark: SparkSession, folders: dict[str, str], newest: int | None = None, skip: tuple[str, ...] = ("MEMORY.md", "README.md")) -> DataFrame:
    """(source, path, file_stem, content, mtime) of the .md files in each label's folder; blank and index files are left out; newest-N for each label if asked."""
    one = [
        spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path).select(F.lit(label).alias("source"), "path", F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("content"))
        for label, path in folders.items()
    ]
    return choose_notes(reduce(DataFrame.unionByName, one), newest, skip)


def choose_notes(files: DataFrame, newest: int | None = None, skip: tuple[str, ...] = ("MEMORY.md", "README.md")) -> DataFrame:
    """files (source, path, mtime, content) with file_stem, without blank and index files; the newest N of each source if asked."""
    named = files.withColumn("_name", F.element_at(F.split("path", "/"), -1)).where(~F.col("_name").isin(*skip) & (F.btrim("content", F.lit(BLANK)) != ""))
    named = named.withColumn("file_stem", F.regexp_replace("_name", r"\.md$", "")).drop("_name")
    if newest is None:
        return named
    w = Window.partitionBy("source").orderBy(F.desc("mtime"), "path")
    return named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest).drop("_r")


def _front(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)\A---[ \t]*\n(.*?)\n---", 1)


def _key(front: Column, key: str) -> Column:
    v = F.btrim(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*)$", 1), F.lit(BLANK + "\"'"))
    return F.when(v != "", v)


def front_matter(content: Column) -> Column:
    """struct(project, sub_scope, type, valid_from, valid_until); missing keys and bad dates are null."""
    f = _front(content)
    return F.struct(_key(f, "project").alias("project"), _key(f, "sub_scope").alias("sub_scope"), _key(f, "type").alias("type"), F.try_to_timestamp(_key(f, "valid_from")).alias("valid_from"), F.try_to_timestamp(_key(f, "valid_until")).alias("valid_until"))


def memory_score(content: Column) -> Column:
    """struct(importance, salience) from the front matter alone: defaults 0.5 and 1.0, clamped to [0, 1] and [0, 5]; NaN takes the default."""
    f = _front(content)

    def number(key: str, default: float, most: float) -> Column:
        v = _key(f, key).try_cast("double")
        return F.least(F.greatest(F.when(v.isNull() | F.isnan(v), default).otherwise(v), F.lit(0.0)), F.lit(most))

    return F.struct(number("importance", 0.5, 1.0).alias("importance"), number("salience", 1.0, 5.0).alias("salience"))


CLASSES = ("public", "internal", "confidential", "restricted")


def acl_front_matter(content: Column) -> Column:
    """struct(acl_allow, classification, error): acl_allow as a YAML block, a flow list or one scalar; classification defaults to internal."""
    f = _front(content)
    flow = F.regexp_extract(f, r"(?m)^acl_allow:[ \t]*\[(.*)\]", 1)
    block = F.regexp_extract(f, r"(?m)^acl_allow:[ \t]*\n((?:[ \t]*-[ \t]*.*\n?)+)", 1)
    scalar = F.regexp_extract(f, r"(?m)^acl_allow:[ \t]*([^\[\s].*)$", 1)
    clean = lambda a: F.filter(F.transform(a, lambda x: F.btrim(x, F.lit(BLANK + "\"'"))), lambda x: x != "")
    acl = F.when(flow != "", clean(F.split(flow, ","))).when(block != "", clean(F.split(F.regexp_replace(block, r"(?m)^[ \t]*-[ \t]*", ""), "\n"))).when(scalar != "", clean(F.array(scalar)))
    level = F.coalesce(F.lower(_key(f, "classification")), F.lit("internal"))
    return F.struct(acl.alias("acl_allow"), level.alias("classification"), F.when(~level.isin(*CLASSES), F.concat(F.lit("unknown classification "), level)).alias("error"))


def discovery_record(files: DataFrame) -> DataFrame:
    """files (file_stem, content) with date (front matter, else file name), tags (list or comma-separated), preview and size."""
    f = _front(F.col("content"))
    stem_date = F.regexp_extract("file_stem", r"^(\d{4}-\d{2}-\d{2})", 1)
    tags = F.regexp_replace(F.coalesce(_key(f, "tags"), F.lit("")), r"[\[\]\"']", "")
    body = F.regexp_replace("content", r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n?", "")
    return files.withColumns({
        "date": F.coalesce(F.try_to_date(_key(f, "date")), F.try_to_date(F.when(stem_date != "", stem_date))),
        "tags": F.filter(F.transform(F.split(tags, ","), lambda t: F.btrim(t)), lambda t: t != ""),
        "preview": F.substring(F.btrim(body, F.lit(BLANK)), 1, 300),
        "size": F.octet_length("content"),
    })


def split_blocks(files: DataFrame, content: str = "content", cut: str = "\n(?=## )") -> DataFrame:
    """One row for each section that isn't blank: chunk_id is the stem, with #i where there are several sections; title from a heading."""
    parts = F.split(content, cut)
    rows = files.withColumn("_n", F.size(parts)).select(*[c for c in files.columns if c != content], "_n", F.posexplode(parts).alias("_i", "_s"))
    rows = rows.withColumn("content", F.btrim("_s", F.lit(BLANK))).where("content <> ''")
    first = F.split("content", "\n", 2)[0]
    return rows.withColumn("chunk_id", F.when(F.col("_n") > 1, F.concat_ws("#", "file_stem", F.col("_i").cast("string"))).otherwise(F.col("file_stem"))).withColumn("title", F.when(first.startswith("#"), F.btrim(F.regexp_replace(first, "^#+", ""))).otherwise("")).drop("_n", "_i", "_s")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with the number of malformed lines)."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    parsed = lines.select(F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt IS NULL").select(*[F.col(f"r.{f.name}") for f in schema.fields]), parsed.agg(F.count_if(F.col("r._corrupt").isNotNull()).alias("skipped"))


def in_days(ts: Column, first: str, last: str) -> Column:
    """Both days included; a plain range, so a scan can prune by it."""
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))


# --- conversation exports: each takes (conversation, json) rows and returns (conversation, i, role, content, created) ---


def _messages(rows: DataFrame, items: Column) -> DataFrame:
    out = rows.select("conversation", F.posexplode(items).alias("i", "m")).select("conversation", "i", F.lower("m.role").alias("role"), F.btrim("m.content", F.lit(BLANK)).alias("content"), "m.created")
    return out.where("content <> ''")


def _item(role: Column, content: Column, created: Column | None = None) -> Column:
    return F.struct(role.alias("role"), content.alias("content"), (F.lit(None).cast("timestamp") if created is None else created).alias("created"))


def mapping_export(rows: DataFrame) -> DataFrame:
    """A list of {title, mapping: {id: {message: {author, content: {parts}, create_time}}}}; user and assistant only, string parts joined."""
    node = "struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>>"
    convs = rows.select(F.posexplode(F.from_json("json", f"array<struct<title:string,mapping:map<string,{node}>>>")).alias("k", "c"), F.col("conversation").alias("_c"))
    msgs = convs.select(F.concat_ws("/", F.col("_c").cast("string"), F.col("k").cast("string")).alias("conversation"), F.explode(F.map_values("c.mapping")).alias("n")).select("conversation", F.col("n.message").alias("x")).where("x IS NOT NULL")
    role, body = F.lower("x.author.role"), F.array_join(F.filter("x.content.parts", lambda p: p.isNotNull()), "\n")
    kept = msgs.select("conversation", role.alias("role"), F.btrim(body).alias("content"), F.timestamp_seconds("x.create_time").alias("created")).where("role IN ('user', 'assistant') AND content <> ''")
    return kept.withColumn("i", F.row_number().over(Window.partitionBy("conversation").orderBy(F.asc_nulls_last("created"), "role", "content")) - 1).select("conversation", "i", "role", "content", "created")


def turn_pair_export(rows: DataFrame) -> DataFrame:
    """[{human, model}] or {conversations: [...]}: each turn gives a user and then an assistant message."""
    kind = "array<struct<human:string,model:string>>"
    turns = F.coalesce(F.from_json("json", f"struct<conversations:{kind}>")["conversations"], F.from_json("json", kind))
    items = F.flatten(F.transform(turns, lambda t: F.array(_item(F.lit("user"), t["human"]), _item(F.lit("assistant"), t["model"]))))
    return _messages(rows, items)


def layered_export(rows: DataFrame) -> DataFrame:
    """{conversations: [{messages}]}, {messages} or a bare list of {role, content}."""
    m = "array<struct<role:string,content:string>>"
    nested = F.flatten(F.transform(F.from_json("json", f"struct<conversations:array<struct<messages:{m}>>>")["conversations"], lambda c: c["messages"]))
    flat = F.coalesce(nested, F.from_json("json", f"struct<messages:{m}>")["messages"], F.from_json("json", m))
    return _messages(rows, F.transform(flat, lambda x: _item(x["role"], x["content"])))


def speaker_turns(texts: DataFrame, key: str, text: str, speakers: tuple[str, ...] = ("user", "human", "assistant", "model", "ai")) -> DataFrame:
    """A text of lines `Speaker: ...` as turns: a line with a speaker starts a turn, others continue it; without any, one assistant message."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    who = F.lower(F.regexp_extract("s", rf"(?i)^({'|'.join(speakers)}):\s*", 1))
    w = Window.partitionBy(key).orderBy("line")
    marked = lines.withColumn("_who", F.when(who != "", who)).withColumn("turn", F.count("_who").over(w)).withColumn("_body", F.regexp_replace("s", rf"(?i)^({'|'.join(speakers)}):\s*", ""))
    turns = marked.groupBy(key, "turn").agg(F.max("_who").alias("who"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_body"))), lambda x: x["_body"]), "\n").alias("content"))
    role = F.when(F.col("who").isin("user", "human"), "user").otherwise("assistant")
    return turns.select(key, F.col("turn").cast("long").alias("turn"), role.alias("role"), F.btrim("content", F.lit(BLANK)).alias("content")).where("content <> ''")


def generic_export(rows: DataFrame) -> DataFrame:
    """A JSON list of {role, content}, else speaker-prefixed text, else one assistant message."""
    as_json = layered_export(rows).select("conversation", F.col("i").cast("long").alias("turn"), "role", "content")
    plain = rows.join(as_json.select("conversation").distinct(), "conversation", "left_anti")
    return as_json.unionByName(speaker_turns(plain, "conversation", "json"))


#: Parsers by layout, provider and MIME type.
PARSERS = {
    "mapping": mapping_export, "turn_pairs": turn_pair_export, "layered": layered_export, "generic": generic_export, "chatgpt": mapping_export, "gemini": turn_pair_export, "deepseek": layered_export,
    "application/json": generic_export, "text/plain": generic_export, "text/markdown": generic_export,
}


def ingest_conversation(messages: DataFrame, provider: str) -> DataFrame:
    """Assistant and model turns of 20 characters or more, with a stable item id and a provider tag."""
    kept = messages.where(F.col("role").isin("assistant", "model") & (F.length(F.btrim("text")) >= 20))
    item = F.concat_ws(":", F.lit("ingest"), F.lit(provider), F.col("turn").cast("string"), F.substring(F.sha2("text", 256), 1, 12))
    return kept.withColumn("item_id", item).withColumn("tags", F.array(F.lit(f"provider:{provider}")))


def first_heading(html: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), r"<[^>]+>", ""))


def html_text(html: Column) -> Column:
    """Block tags become line ends, scripts and other tags go, common entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<(/?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article)\b)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(t, r"\n[ \t]*(\n[ \t]*)+", "\n\n"), F.lit(BLANK))


def decode_bytes(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def paragraph_chunks(text: Column, most: int) -> Column:
    """Paragraphs; those longer than `most` characters are cut at sentences."""
    paras = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(BLANK))), lambda p: p != "")
    return F.flatten(F.transform(paras, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(tx.sentence_chunks(p, most))))


def rows_to_chunks(rows: DataFrame, key: str, columns: list[str], each: int) -> DataFrame:
    """Rows numbered by a dense 0-based key as lines of cells joined with ` | `, `each` rows a chunk."""
    line = F.concat_ws(" | ", *[F.when(F.btrim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in columns])
    grouped = rows.select(F.floor(F.col(key) / each).alias("chunk"), F.struct(F.col(key).alias("k"), line.alias("line")).alias("s")).groupBy("chunk")
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("text"))


def table_chunks(rows: DataFrame, sheet: str, order: str, columns: list[str], each: int = 50) -> DataFrame:
    """Rows of sheets, in any ascending order column, as (sheet, chunk, heading, text): the first row of a sheet is its heading, the others are lines of non-blank cells joined with
    ` | `, `each` to a chunk. Rows are numbered in a window of their sheet; a chunk gathers `each` lines."""
    line = F.concat_ws(" | ", *[F.when(F.btrim(F.col(c).cast("string")) != "", F.btrim(F.col(c).cast("string"))) for c in columns])
    w = Window.partitionBy(sheet).orderBy(order)
    numbered = rows.select(sheet, (F.row_number().over(w) - 1).alias("i"), F.first(line).over(w).alias("heading"), line.alias("line")).where("i > 0")
    grouped = numbered.groupBy(sheet, F.floor((F.col("i") - 1) / each).alias("chunk"), "heading").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("s"))
    return grouped.select(sheet, "chunk", "heading", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("text"))


def mine_prompts(messages: DataFrame, least: int) -> DataFrame:
    """User messages of `least` characters that no tool wrote, redacted, the first of each normalised text."""
    kept = messages.where((F.col("role") == "user") & (F.length("text") >= least) & ~tx.is_wrapper(F.col("text"))).withColumn("_h", tx.normalised_hash(F.col("text")))
    first = kept.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("conv_id", "turn"))).where("_r = 1").drop("_r", "_h")
    return first.withColumn("text", tx.redact(F.col("text")))


def session_keywords(messages: DataFrame, most: int, stop: tuple[str, ...]) -> DataFrame:
    """The most frequent words of three letters or more of each conversation; ties go to the first seen."""
    words = messages.select("conv_id", "turn", F.posexplode(tx.matches(F.col("text"), r"[a-zA-Z][a-zA-Z0-9_]{2,}")).alias("i", "w")).withColumn("word", F.lower("w")).where(~F.col("word").isin(*stop))
    counts = words.groupBy("conv_id", "word").agg(F.count("*").alias("n"), F.min(F.col("turn") * 100_000 + F.col("i")).alias("_first"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "_first"))).where(F.col("r") <= most).drop("_first")


def parse_backlog(files: DataFrame, path: str, content: str) -> DataFrame:
    """Heading and check-box lines as epics (#), stories (##) and tasks (- [ ]); a child belongs to the latest parent before it."""
    lines = files.select(path, F.posexplode(F.split(content, "\n")).alias("line", "s"))
    kind = F.when(F.col("s").rlike(r"^# "), "epic").when(F.col("s").rlike(r"^##+ "), "story").when(F.col("s").rlike(r"^\s*- \[[ xX]\] "), "task")
    rows = lines.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("title", F.btrim(F.regexp_replace("s", r"^(#+|\s*- \[[ xX]\])\s*", "")))
    w = Window.partitionBy(path).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    epic = F.last(F.when(F.col("kind") == "epic", F.col("title")), ignorenulls=True).over(w)
    story = F.last(F.when(F.col("kind") == "story", F.col("title")), ignorenulls=True).over(w)
    return rows.withColumn("parent", F.when(F.col("kind") == "story", epic).when(F.col("kind") == "task", F.coalesce(story, epic))).withColumn("done", F.col("s").rlike(r"\[[xX]\]")).drop("s")


def apply_feed(feed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The items that a feed of adds and deletes leaves: the latest entry of each key, if it is an add."""
    latest = feed.groupBy(*keys).agg(F.max_by("op", order).alias("op"), F.max(order).alias(order))
    return latest.where("op <> 'delete'").drop("op")


def permission_principals(rows: DataFrame) -> DataFrame:
    """rows (item, json) of permission lists flattened to principal ids; roles read, write or owner count; three grant fields in order."""
    who = "struct<user:struct<id:string>,group:struct<id:string>>"
    kind = f"array<struct<roles:array<string>,grantedToV2:{who},grantedTo:{who},grantedToIdentitiesV2:array<{who}>>>"
    p = rows.select("item", F.explode(F.from_json("json", kind)).alias("p")).where(F.arrays_overlap("p.roles", F.array(F.lit("read"), F.lit("write"), F.lit("owner"))))
    grants = F.coalesce(F.when(F.col("p.grantedToV2").isNotNull(), F.array("p.grantedToV2")), F.col("p.grantedToIdentitiesV2"), F.when(F.col("p.grantedTo").isNotNull(), F.array("p.grantedTo")))
    ids = p.select("item", F.explode(grants).alias("g")).select("item", F.explode(F.array("g.user.id", "g.group.id")).alias("principal"))
    return ids.where("principal IS NOT NULL").distinct()


def classify_labels(rows: DataFrame, labels: DataFrame, default: str) -> DataFrame:
    """rows with the classification of their label, without regard to case; the default where it is unknown. labels: a small dimension."""
    dim = labels.select(F.lower("label").alias("_l"), F.col("classification").alias("_c"))
    return rows.join(dim, F.lower(rows["label"]) == F.col("_l"), "left").withColumn("classification", F.coalesce("_c", F.lit(default))).drop("_l", "_c")


def file_states(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """(path, state): new, changed or same for incoming rows by content hash; vanished for index rows without a file."""
    now = incoming.select("path", F.sha2("content", 256).alias("_now"))
    both = now.join(index.select("path", F.col("sha256").alias("_old")), "path", "full_outer")
    state = F.when(F.col("_now").isNull(), "vanished").when(F.col("_old").isNull(), "new").when(F.col("_now") == F.col("_old"), "same").otherwise("changed")
    return both.select("path", state.alias("state"))


def changed_files(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows that are new or changed against the index, with their state; unchanged ones aren't read again."""
    return incoming.join(file_states(index, incoming).where("state IN ('new', 'changed')"), "path")
