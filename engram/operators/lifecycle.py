"""Memory lifecycle jobs (LC) and upserts (SNK2, SNK3): new snapshots from old ones, never updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Daily decay of high, middle and low importance, its bounds and the archive limit. Fixed values.
RATES = ((0.8, 0.01), (0.5, 0.02))
LOW_RATE, ARCHIVE_BELOW, MOST = 0.05, 0.05, 5.0


def decay(memories: DataFrame, days: int, today: str) -> DataFrame:
    """memories (importance, salience, pinned, last_decay) with the new salience and an outcome: pinned, already_decayed, archived, decayed."""
    rate = F.lit(LOW_RATE)
    for least, r in reversed(RATES):
        rate = F.when(F.col("importance") >= least, r).otherwise(rate)
    new = F.least(F.greatest(F.col("salience") * F.pow(1 - rate, F.lit(days)), F.lit(0.0)), F.lit(MOST))
    done = F.coalesce(F.col("last_decay") >= F.lit(today).cast("date"), F.lit(False))
    outcome = F.when(F.col("pinned"), "pinned").when(done, "already_decayed").when(new < ARCHIVE_BELOW, "archived").otherwise("decayed")
    out = memories.withColumn("outcome", outcome)
    return out.withColumn("salience", F.when(F.col("outcome").isin("decayed", "archived"), new).otherwise(F.col("salience")))


def prune_candidates(files: DataFrame, recalled: DataFrame, age_days: int = 90, superseded_days: int = 7) -> DataFrame:
    """files (stem, age, pinned, superseded): superseded ones of some age and old ones that aren't pinned or recalled."""
    reason = F.when(F.col("superseded") & (F.col("age") >= superseded_days), "superseded").when(F.col("age") > age_days, "age")
    return files.where(~F.col("pinned")).withColumn("reason", reason).where("reason IS NOT NULL").join(recalled.select("stem"), "stem", "left_anti")


def archive_candidates(memories: DataFrame, days: int = 180) -> DataFrame:
    return memories.where((F.col("status") == "stale") & ~F.col("pinned") & (F.col("age") > days))


def hygiene(memories: DataFrame, recalled: DataFrame, days: int, today: str) -> DataFrame:
    """Decay, dedup by content, prune: one report row for each project."""
    decayed = decay(memories, days, today)
    w = Window.partitionBy("project", F.sha2("content", 256)).orderBy("stem")
    marked = decayed.withColumn("_copy", F.row_number().over(w) > 1).withColumn("superseded", F.col("superseded") | F.col("_copy"))
    gone = prune_candidates(marked, recalled).select("stem", F.lit(True).alias("_pruned"))
    both = marked.join(gone, "stem", "left")
    return both.groupBy("project").agg(
        F.count("*").alias("files"), F.count_if(F.col("outcome") == "decayed").alias("decayed"), F.count_if(F.col("outcome") == "archived").alias("archived"),
        F.count_if("_copy").alias("duplicates"), F.count_if(F.coalesce("_pruned", F.lit(False))).alias("pruned"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Current state of each memory from its events (memory_id, event_type): verified adds a verification and 0.05 confidence up to 1, superseded
    ends it. Neither depends on the order, so partial sums of each task add up and no history is gathered."""
    ok = F.count_if(F.col("event_type") == "verified")
    status = F.when(F.coalesce(F.bool_or(F.col("event_type") == "superseded"), F.lit(False)), "superseded").otherwise("active")
    return events.groupBy("memory_id").agg(status.alias("status"), ok.cast("int").alias("verifications"), F.least(0.7 + 0.05 * ok, F.lit(1.0)).alias("confidence"), F.count("*").alias("events"))


def nightly_hygiene(memories: DataFrame, recalled: DataFrame, checkpoints: DataFrame, days: int, today: str, threshold: float = 0.92, ttl_days: int = 30) -> DataFrame:
    """The nightly job of each project: memories (stem, project, content, importance, salience, pinned, last_decay, age, superseded) decay; of near-duplicates the older
    (on equal ages the larger stem) is superseded; prune candidates are counted; checkpoints (project, created_at) older than ttl_days expire.

    One row a project that has memories or checkpoints: total, decayed, archived, skipped, duplicates_merged, candidates_pruned, checkpoints_expired.
    """
    from engram.operators.joins import near_duplicate_losers

    decayed = decay(memories, days, today)
    rows = decayed.where("project IS NOT NULL").select(F.col("stem").alias("id"), "project", (-F.col("age")).alias("confidence"), F.col("content").alias("text"))
    lost = near_duplicate_losers(rows, threshold).select(F.col("id").alias("stem"), F.lit(True).alias("_dup"))
    marked = decayed.join(lost, "stem", "left").withColumn("_dup", F.coalesce("_dup", F.lit(False))).withColumn("superseded", F.col("superseded") | F.col("_dup"))
    gone = prune_candidates(marked, recalled).select("stem", F.lit(True).alias("_pruned"))
    report = marked.join(gone, "stem", "left").groupBy("project").agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") == "decayed").alias("decayed"), F.count_if(F.col("outcome") == "archived").alias("archived"), F.count_if(F.col("outcome").isin("pinned", "already_decayed")).alias("skipped"),
        F.count_if("_dup").alias("duplicates_merged"), F.count_if(F.coalesce("_pruned", F.lit(False))).alias("candidates_pruned"),
    )
    old = checkpoints.where(F.col("created_at") < F.lit(today).cast("timestamp_ntz") - F.expr(f"INTERVAL '{ttl_days}' DAY")).groupBy("project").agg(F.count("*").alias("checkpoints_expired"))
    known = checkpoints.select("project").distinct().join(old, "project", "left")
    return report.join(known, "project", "full_outer").fillna(0)


def backfill_lines(lines: DataFrame, acl: list[str], level: str) -> DataFrame:
    """lines (value) of JSON objects: the text with the missing or null keys acl_allow and classification filled in, and what was done: filled, kept or malformed (left as it
    is). A dry run is the count of each without a write; running it again fills nothing."""
    kind = "struct<acl_allow:array<string>,classification:string>"
    whole = F.try_parse_json(F.col("value"))
    ok = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    parsed = F.from_json("value", kind)
    need = ok & (parsed["acl_allow"].isNull() | parsed["classification"].isNull())
    rest = F.regexp_replace(F.regexp_replace("value", r'"(acl_allow|classification)"\s*:\s*null\s*,?', ""), r",?\s*}\s*$", "")
    added = F.concat_ws(",", F.when(parsed["acl_allow"].isNull(), F.concat(F.lit('"acl_allow":'), F.to_json(F.array(*[F.lit(a) for a in acl])))), F.when(parsed["classification"].isNull(), F.concat(F.lit('"classification":'), F.lit(f'"{level}"'))))
    new = F.concat(rest, F.when(F.btrim(rest) == "{", "").otherwise(","), added, F.lit("}"))
    return lines.select("value", F.when(need, new).otherwise(F.col("value")).alias("line"), F.when(~ok, "malformed").when(need, "filled").otherwise("kept").alias("outcome"))


def recall_feedback(feedback: DataFrame, recalls: DataFrame, hours: int = 24) -> DataFrame:
    """Per file +0.1 for each used and -0.05 for each ignored chunk, once for a recall and chunk, if within `hours` of the recall; clamped to [-1, 1]."""
    timely = feedback.join(recalls.select("recall_id", F.col("ts").alias("_t")), "recall_id").where((F.col("ts") >= F.col("_t")) & (F.col("ts") <= F.col("_t") + F.expr(f"INTERVAL '{hours}' HOUR")))
    first = timely.withColumn("_r", F.row_number().over(Window.partitionBy("recall_id", "chunk_id").orderBy("ts", "event_id"))).where("_r = 1")
    gain = F.when(F.col("used"), 0.1).otherwise(-0.05)
    return first.groupBy("file").agg(F.least(F.greatest(F.sum(gain), F.lit(-1.0)), F.lit(1.0)).alias("delta"), F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("ignored"))


def override(rows: DataFrame, changes: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    """The latest change (key, column, ts) of each key wins, clamped."""
    last = changes.groupBy(key).agg(F.max_by(column, "ts").alias("_new"))
    return rows.join(last, key, "left").withColumn(column, F.when(F.col("_new").isNotNull(), F.least(F.greatest("_new", F.lit(low)), F.lit(high))).otherwise(F.col(column))).drop("_new")


def quarantine(attempts: DataFrame, now: Column, most: int = 3, wait_minutes: int = 10) -> DataFrame:
    """attempts (doc, ts, ok): state of each document: done, exhausted at `most` failures, retryable or waiting."""
    s = attempts.groupBy("doc").agg(F.count_if(~F.col("ok")).alias("failures"), F.max("ts").alias("last"), F.bool_or("ok").alias("done"))
    ready = F.col("last") + F.expr(f"INTERVAL '{wait_minutes}' MINUTE") <= now
    return s.withColumn("state", F.when(F.col("done"), "done").when(F.col("failures") >= most, "exhausted").when(ready, "retryable").otherwise("waiting"))


def backfill_acl(rows: DataFrame, acl: list[str], level: str) -> DataFrame:
    """Null ACLs and classes take defaults; `filled` says where; running it again changes nothing."""
    default = F.array(*[F.lit(a) for a in acl])
    return rows.withColumn("filled", F.col("acl_allow").isNull() | F.col("classification").isNull()).withColumn("acl_allow", F.coalesce("acl_allow", default)).withColumn("classification", F.coalesce("classification", F.lit(level)))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], order: str) -> DataFrame:
    """A new snapshot: the latest row of each key replaces the old one but for the columns in `keep`, which stay from the first."""
    latest = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r", order)
    prior = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    changed = latest.join(prior, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in latest.columns if c != key])
    return old.join(latest.select(key), key, "left_anti").unionByName(changed.select(*old.columns))
