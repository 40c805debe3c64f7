"""Graph operators (GR) over edges (edge_id, source_id, target_id, relationship, ...); edges are read as undirected."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators.joins import written


def undirected(edges: DataFrame) -> DataFrame:
    keep = [c for c in edges.columns if c not in ("source_id", "target_id")]
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), *keep).union(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), *keep))


def edges_of(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, at: Column | None = None) -> DataFrame:
    """Edges that touch a node of nodes (node), by kind, and valid at a time (a malformed or missing end keeps the edge)."""
    both = undirected(edges).withColumnRenamed("a", "node").join(nodes, "node", "left_semi")
    if kinds:
        both = both.where(F.col("relationship").isin(kinds))
    return both if at is None else both.where(F.coalesce(F.try_to_timestamp("valid_until") >= at, F.lit(True)))


def invalidate(edges: DataFrame, edge_ids: DataFrame, at: str) -> DataFrame:
    hit = edge_ids.select("edge_id", F.lit(at).alias("_t")).distinct()
    return edges.join(hit, "edge_id", "left").withColumn("valid_until", F.coalesce("_t", "valid_until")).drop("_t")


def k_hops(edges: DataFrame, origins: DataFrame, hops: int = 2, kinds: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(origin, node, depth) of all nodes within `hops` (3 at most) of each origin; a node that isn't allowed blocks the paths through it."""
    if not 1 <= hops <= 3:
        raise ValueError("1 to 3 hops")
    step = undirected(edges if kinds is None else edges.where(F.col("relationship").isin(kinds))).select("a", "b").distinct()
    if allowed is not None:
        step = step.join(allowed.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    step = written(step)  # every hop reads it
    frontier = origins.select(F.col("node").alias("origin"), "node").distinct()
    if allowed is not None:
        frontier = frontier.join(allowed, "node", "left_semi").select("origin", "node")
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        reached = frontier.join(step, frontier["node"] == step["a"]).select("origin", F.col("b").alias("node")).distinct()
        frontier = reached.join(seen, ["origin", "node"], "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen


def score_boost(hits: DataFrame, mentions: DataFrame, linked: DataFrame, each: float = 0.1, most: float = 0.3) -> DataFrame:
    """hits (query_id, id, score) + `each` x weight for every linked entity that the hit mentions, `most` at the most.
    mentions (id, entity), linked (query_id, entity, weight)."""
    gain = mentions.join(linked, "entity").groupBy("query_id", "id").agg(F.least(F.sum(F.col("weight") * each), F.lit(most)).alias("_g"))
    return hits.join(gain, ["query_id", "id"], "left").withColumn("score", F.col("score") + F.coalesce("_g", F.lit(0.0))).drop("_g")


def precedence_boost(hits: DataFrame, edges: DataFrame, top: int = 5, factor: float = 1.1) -> DataFrame:
    """Neighbours of a query's top hits get `factor` x its best score; re-ranked."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    near = hits.where(F.col("rank") <= top).select("query_id", F.col("id").alias("a")).join(undirected(edges).select("a", "b"), "a").select("query_id", F.col("b").alias("id")).distinct()
    lifted = near.join(best, "query_id").select("query_id", "id", (F.col("_best") * factor).alias("score"))
    both = hits.select("query_id", "id", "score").unionByName(lifted).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")))


def observers(received: DataFrame) -> DataFrame:
    """received (memory, agent, ts, event_id): the first row of each agent and memory."""
    w = Window.partitionBy("memory", "agent").orderBy("ts", "event_id")
    return received.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def seed_bundle(refs: DataFrame, names: DataFrame, goal: list[str], now: Column, k: int) -> DataFrame:
    """refs (memory, agent, ts) of recent events, names (memory, words): Jaccard(goal, words) x exp(-days / 7) x ln(2 + observers)."""
    from engram.functions.text import jaccard

    stats = refs.groupBy("memory").agg(F.count_distinct("agent").alias("observers"), F.max("ts").alias("last"))
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 8.64e10
    scored = stats.join(names, "memory").withColumn("score", jaccard(F.col("words"), F.array(*[F.lit(g) for g in goal])) * F.exp(-days / 7) * F.ln(2 + F.col("observers")))
    return scored.orderBy(F.round("score", 9).desc(), "memory").limit(k)


def publish(events: DataFrame) -> DataFrame:
    """events (event_id, content, agent, ts): one memory for each content hash with its first time and number of publications."""
    h = F.substring(F.sha2("content", 256), 1, 12)
    return events.groupBy(h.alias("memory_id")).agg(F.min("ts").alias("first_seen"), F.count("*").alias("published"), F.count_distinct("agent").alias("agents"))


def publications(events: DataFrame) -> DataFrame:
    """events (event_id, content, agent, ts) as AGENT_PUBLISHED edges: source_id (the agent), target_id (the memory), edge_id, event_id and ts of its first publication by
    that agent, publications, and is_duplicate (another event published the memory before)."""
    h = F.substring(F.sha2("content", 256), 1, 12)
    when = F.struct("ts", "event_id")
    rows = events.where("content IS NOT NULL AND agent IS NOT NULL").withColumn("memory_id", h)
    first = rows.groupBy("memory_id").agg(F.min(when).alias("_first"))
    edges = rows.groupBy("agent", "memory_id").agg(F.min(when).alias("_own"), F.count("*").alias("publications")).join(first, "memory_id")
    edge = tx.short_id(F.col("agent"), F.col("memory_id"), F.lit("AGENT_PUBLISHED"))
    return edges.select(F.col("agent").alias("source_id"), F.col("memory_id").alias("target_id"), edge.alias("edge_id"), F.col("_own.event_id").alias("event_id"), F.col("_own.ts").alias("ts"), "publications", (F.col("_own") != F.col("_first")).alias("is_duplicate"))


CONFIDENT = 0.7


def named_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, text, node) for every confident entity (node, name, confidence) that a query (query_id, text) names as a whole word, without regard to case.

    Queries and names meet on the name's first word; only then is the whole name looked for.
    """
    named = entities.where(F.col("confidence") >= CONFIDENT).select("node", F.lower(F.rtrim("name", F.lit("()"))).alias("_n")).where("_n <> ''")
    word = r"[\p{L}\p{N}_]+"
    keyed = named.withColumn("_k", F.regexp_extract("_n", word, 0)).where("_k <> ''")
    words = queries.select("query_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), 0))).alias("_k"))
    both = words.join(keyed, "_k")
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.col("_n"), F.lit(r"\E\b"))
    return both.where(F.rlike(F.lower("text"), quoted)).select("query_id", "text", "node").distinct()


def expand_queries(queries: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, expanded): each query's text followed by the names of confident neighbours of the entities it names, in order of the named entity and the
    neighbour; a name that the text holds already isn't added, nor is one twice."""
    named = named_entities(queries, entities)
    near = named.join(undirected(edges).select(F.col("a").alias("node"), F.col("b")).distinct(), "node").where("b <> node")
    names = entities.where(F.col("confidence") >= CONFIDENT).select(F.col("node").alias("b"), F.rtrim("name", F.lit("()")).alias("term"))
    terms = near.join(names, "b").where(~F.contains(F.lower("text"), F.lower("term")))
    first = terms.groupBy("query_id", "term").agg(F.min(F.struct("node", "b")).alias("o"))
    extra = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "term"))), lambda x: x["term"]), " ").alias("_extra"))
    return queries.join(extra, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "_extra").alias("expanded"))


def link_and_store(sessions: DataFrame, edges: DataFrame, entity_path: str, edge_path: str, dry_run: bool = False) -> DataFrame:
    """Session entities and PRECEDED_BY edges by entity id, appended as Parquet where they aren't stored yet; one row: sessions, edges_added, dry_run.

    sessions (id, project, ts, vocabulary), edges (source_id, target_id, overlap, delta_hours). A dry run writes nothing.
    """
    spark = sessions.sparkSession
    entity = lambda i, p: tx.short_id(i, F.lit("session"), p)
    project = F.coalesce("project", F.lit("unknown"))
    ids = sessions.select("id", entity(F.col("id"), project).alias("entity_id"), project.alias("project"))
    linked = edges.join(ids.select(F.col("id").alias("source_id"), F.col("entity_id").alias("s"), F.col("project").alias("acl")), "source_id").join(ids.select(F.col("id").alias("target_id"), F.col("entity_id").alias("t")), "target_id")
    edge_rows = linked.select(tx.short_id(F.col("s"), F.col("t"), F.lit("PRECEDED_BY")).alias("edge_id"), F.col("s").alias("source_id"), F.col("t").alias("target_id"), F.lit("PRECEDED_BY").alias("relationship"), "overlap", "delta_hours", F.array("acl").alias("acl_allow"))
    nodes = sessions.select(entity(F.col("id"), project).alias("entity_id"), F.col("id").cast("string").alias("name"), F.lit("session").alias("type"), project.alias("project"), F.col("ts").alias("first_seen"), F.size("vocabulary").alias("vocabulary_size"), F.array(project).alias("acl_allow"))
    if not dry_run:
        for rows, path, key in ((nodes, entity_path, "entity_id"), (edge_rows, edge_path, "edge_id")):
            try:
                rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
            except AnalysisException:  # nothing stored yet
                pass
            rows.write.mode("append").parquet(path)
    return sessions.agg(F.count("*").alias("sessions")).crossJoin(edge_rows.agg(F.count("*").alias("edges_added"))).withColumn("dry_run", F.lit(dry_run))
