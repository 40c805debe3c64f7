"""Streams that grow between runs: a change feed into a bucketed snapshot, and ordered folds fed in several micro-batches with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import logs
from engram.plans.governance import REC, rec
from engram.plans.registry import query, table
from engram.plans.retrieval import POOL, pool
from engram.plans.streams import folder
from engram.sources import feed, snapshot
from engram.streaming import stateful as sf_

RUNS = 4


def fed(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], runs: int = RUNS) -> DataFrame:
    """What make(stream) gives for rows that arrive in `runs` runs, each restarted from the checkpoint of the one before; every third row comes 30 minutes late."""
    at = folder(spark)
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    arrival = F.unix_micros("ts") + F.when(F.col("event_id") % 3 == 0, 1_800_000_000).otherwise(0)
    run = F.least(F.floor((arrival - (ends["a"] or 0)) * runs / ((ends["b"] or 0) - (ends["a"] or 0) + 1)), F.lit(runs - 1))
    for i in range(runs):
        rows.where(run == i).write.mode("append").parquet(f"{at}/in")
        with sf_.rocksdb(spark):
            stream = make(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def closed(spark, sf, out: DataFrame) -> DataFrame:
    """The rows that the watermark has passed for certain."""
    end = events(spark, sf).agg((F.floor(F.max(F.unix_micros("ts")) / 1_000_000) - 3602).alias("_end"))
    return out.join(F.broadcast(end), F.floor(out["at"] / 1_000_000) < F.col("_end")).drop("_end")


OVER = "epoch_us(ts) // 1000000 < (SELECT epoch_us(max(ts)) // 1000000 - 3602 FROM events)"


@query("st5_expiring_dedup", f"""WITH RECURSIVE o AS (SELECT user_id AS k, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(k, n, last, event_id, kept) AS (SELECT k, n, ts, event_id, true FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, CASE WHEN epoch_us(o.ts) - epoch_us(f.last) > 7200000000 THEN o.ts ELSE f.last END, o.event_id, epoch_us(o.ts) - epoch_us(f.last) > 7200000000 FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
SELECT k AS key, event_id, kept AS accepted FROM f JOIN events USING (event_id) WHERE {OVER}""")
def st5b(spark, sf):
    out = fed(spark, events(spark, sf).select("user_id", "event_id", "ts"), lambda s: sf_.kept_rows(s, "user_id", 7200))
    return closed(spark, sf, out).select("key", "event_id", "accepted")


@query("st6_accepted_calls", f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, n, event_id, last, before, accepted) AS (SELECT user_id, n, event_id, t, CAST(NULL AS BIGINT), true FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN coalesce(o.t - before >= 7200000000, true) THEN o.t ELSE last END, CASE WHEN coalesce(o.t - before >= 7200000000, true) THEN last ELSE before END, coalesce(o.t - before >= 7200000000, true) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT f.user_id AS key, event_id, accepted FROM f JOIN events USING (event_id) WHERE {OVER}""")
def st6b(spark, sf):
    out = fed(spark, events(spark, sf).select("user_id", "event_id", "ts"), lambda s: sf_.rate_limit(s, "user_id", 2, 7200))
    return closed(spark, sf, out).select("key", "event_id", "accepted")


@query("st6_export_alerts", f"""WITH s AS (SELECT event_id, user_id % 5 AS p, event_type AS project, epoch_us(ts) // 1000000 AS s FROM events),
a AS (SELECT a.event_id, a.p AS key, count(*) AS in_window, count(DISTINCT b.project) AS projects FROM s a JOIN s b ON a.p = b.p AND b.s BETWEEN a.s - 3600 AND a.s GROUP BY 1, 2)
SELECT key, event_id, in_window, projects, in_window > 2 AS is_burst, projects >= 3 AS is_sweep FROM a JOIN events USING (event_id) WHERE (in_window > 2 OR projects >= 3) AND {OVER}""")
def st6c(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") % 5).alias("principal"), "event_id", "ts", F.col("event_type").alias("project"))
    return closed(spark, sf, fed(spark, rows, lambda s: sf_.export_alerts(s, "principal", 3600, 2, 3))).drop("at")


@query("st8_think_times", f"""SELECT event_id, CASE WHEN t - p <= 86400000000 THEN round(greatest(t / 1000.0 - (p / 1000.0 + d), 0.0), 1) END AS think_ms FROM (SELECT event_id, ts, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS p, lag(value * 1000) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE {OVER}""")
def st8b(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", "ts", (F.col("value") * 1000).alias("duration_ms"))
    return closed(spark, sf, fed(spark, rows, lambda s: sf_.think_times(s, "user_id", "duration_ms"))).select("event_id", "think_ms")


def order_pages(spark, sf) -> DataFrame:
    """Orders as a feed of drives: an order is added, every third is deleted and every twelfth added again, each a page later."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    page = F.pmod(F.xxhash64("o_orderkey"), F.lit(4)).cast("long")
    where = [F.concat(F.lit("t"), (k % 2).cast("string")).alias("tenant"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("site"), F.concat(F.lit("d"), (k % 5).cast("string")).alias("drive")]
    row = lambda late, op, note: [*where, (page + late).alias("page"), k.cast("string").alias("item"), F.lit(op).alias("op"), F.lit(note).alias("payload")]
    return o.select(*row(0, "add", "first")).unionByName(o.where("o_orderkey % 3 = 0").select(*row(1, "delete", None))).unionByName(o.where("o_orderkey % 12 = 0").select(*row(2, "add", "again")))


@query("src18_feed_stream", """SELECT 't' || (o_orderkey % 2) AS tenant, 's' || (o_orderkey % 3) AS site, 'd' || (o_orderkey % 5) AS drive, o_orderkey AS item, CASE WHEN o_orderkey % 12 = 0 THEN 'again' ELSE 'first' END AS payload FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 12 = 0""")
def src18b(spark, sf):
    """Two runs over a growing feed, the second from the cursors of the first; every batch goes into a snapshot."""
    at, rows = folder(spark), order_pages(spark, sf)

    def apply(batch: DataFrame, batch_id: int) -> None:
        snapshot.upsert(f"{at}/table", batch, ["tenant", "site", "drive", "item"], "page", op="op")

    for some in (F.col("page") < 3, F.col("page") >= 3):
        feed.write_pages(rows.where(some), f"{at}/feed")
        feed.read_feed(spark, f"{at}/feed").writeStream.foreachBatch(apply).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return snapshot.read(spark, f"{at}/table").select("tenant", "site", "drive", F.col("item").cast("long").alias("item"), "payload")


def customer_changes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("created"), F.col("c_acctbal").alias("balance"), F.array(F.col("c_mktsegment")).alias("acl"))
    new = c.where("c_custkey % 3 = 0").unionByName(c.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)).withColumn("created", F.lit(-1).cast("long"))
    empty = F.when(F.col("c_custkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("acl"))
    first = new.withColumn("balance", F.col("balance") + 1).withColumn("at", F.lit(1))
    return c.withColumn("at", F.lit(0)), first.unionByName(new.withColumn("balance", F.col("balance") + 2).withColumn("at", F.lit(2)).withColumn("acl", empty))


CHANGES = """WITH n AS (SELECT c_custkey, c_acctbal AS b FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 50 = 0)"""


@query("snk3_snapshot", CHANGES + """ SELECT c_custkey, coalesce(c_nationkey, -1) AS created, CASE WHEN b IS NULL THEN c_acctbal WHEN c_custkey % 7 = 0 THEN b + 1 ELSE b + 2 END AS balance FROM customer FULL JOIN n USING (c_custkey)""")
def snk3b(spark, sf):
    at, (old, changes) = folder(spark), customer_changes(spark, sf)
    snapshot.upsert(at, old, ["c_custkey"], "at", buckets=16)
    snapshot.upsert(at, changes, ["c_custkey"], "at", kept=("created",), valid=F.size("acl") > 0)
    return snapshot.read(spark, at).select("c_custkey", "created", "balance")


@query("snk3_rejects", CHANGES + " SELECT c_custkey, b + 2 AS balance FROM n WHERE c_custkey % 7 = 0")
def snk3c(spark, sf):
    at, (old, changes) = folder(spark), customer_changes(spark, sf)
    snapshot.upsert(at, old, ["c_custkey"], "at", buckets=16)
    return snapshot.upsert(at, changes, ["c_custkey"], "at", kept=("created",), valid=F.size("acl") > 0).select("c_custkey", "balance")


# --- counts and side tables of what is dropped -------------------------------


@query("fl6_leak_rows", REC + "SELECT id FROM rec WHERE NOT coalesce(acl IS NULL OR list_has_any(acl, ['bob']), false)")
def fl6b(spark, sf):
    return logs.verified(rec(spark, sf).select("id", "acl"), "acl", ["bob"], folder(spark))[1].select("id")


@query("fl6_leak_counts", REC + "SELECT count(*) AS checked, count(*) FILTER (acl IS NULL) AS open, count(*) FILTER (NOT list_has_any(acl, ['bob'])) AS leaked FROM rec")
def fl6c(spark, sf):
    return spark.createDataFrame([logs.verified(rec(spark, sf).select("id", "acl"), "acl", ["bob"], folder(spark))[2]], "checked long, open long, leaked long")


GATES = POOL + """, k AS (SELECT *, score >= 0.35 AS g1, score >= 0.35 AND lex >= 3 AS g2, count(*) FILTER (score >= 0.35 AND lex >= 3) OVER (PARTITION BY query_id) AS kept FROM pool)
SELECT count(*) AS entered, count(*) FILTER (g1) AS near, count(*) FILTER (g2) AS lexical, count(*) FILTER (g2 OR kept = 0) AS returned, count(*) FILTER (kept = 0) AS fallback FROM k"""


@query("rk23_gate_log", GATES)
def rk23b(spark, sf):
    counts = logs.gated(pool(spark, sf).select("query_id", "id", "score", "lex"), {"near": F.round("score", 9) >= 0.35, "lexical": F.col("lex") >= 3}, folder(spark))[1]
    return spark.createDataFrame([counts], "entered long, near long, lexical long, returned long, fallback long")


@query("src16_mining_counts", r"""WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM 'user' THEN 'o' WHEN coalesce(length(text) < 40, true) THEN 's' ELSE 'c' END AS why FROM conversations)
SELECT count(*) AS messages, count(*) FILTER (why = 'o') AS other_role, count(*) FILTER (why = 's') AS too_short, count(*) FILTER (why = 'c') AS candidates, count(DISTINCT CASE WHEN why = 'c' THEN regexp_replace(lower(trim(text, E' \t\n\r\f\x0b')), '\s+', ' ', 'g') END) AS kept FROM c""")
def src16b(spark, sf):
    counts = logs.mined(table(spark, sf, "conversations"), 40, folder(spark))[1]
    return spark.createDataFrame([{k: v for k, v in counts.items() if k not in ("wrapper", "duplicates")}], "messages long, other_role long, too_short long, candidates long, kept long")
