"""Streaming operators over `events` as a stream that is drained; each equals a batch operator on complete data."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators.joins import shared_folder
from engram.plans.governance import LINKS
from engram.plans.registry import query, table
from engram.streaming import operators as st


def folder(spark) -> str:
    """A new folder in the shared checkpoint place."""
    return shared_folder(spark, "stream")


def stream(spark, sf):
    rows = table(spark, sf, "events")
    s = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet" if _is_dir(spark, f"{sf}/events.parquet") else f"{sf}/[e]vents.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("principal_id", F.col("user_id"))


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(spark, df):
    at = folder(spark)
    return st.run_now(df, f"{at}/out", f"{at}/log")


@query("st1_publish_dedup", "SELECT DISTINCT event_type, user_id FROM events")
def st1(spark, sf):
    s = stream(spark, sf).withColumn("content", F.concat("event_type", F.col("user_id").cast("string")))
    return drained(spark, st.publish(s, watermark="3650 days").select("event_type", "user_id"))


@query("st2_subscribe", "SELECT event_id FROM events WHERE user_id % 4 = 1 AND event_id > 100")
def st2(spark, sf):
    return drained(spark, st.subscribe(stream(spark, sf).withColumn("project", (F.col("user_id") % 4).cast("string")), ["1"], 100).select("event_id"))


@query("st3_bus", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND user_id = 7")
def st3(spark, sf):
    s = stream(spark, sf).withColumn("tags", F.array("event_type")).withColumn("source_agent", F.col("user_id").cast("string"))
    return drained(spark, st.bus(s, ["click", "error"], "7").select("event_id"))


@query("st4_event_log", "SELECT event_id FROM events WHERE user_id % 4 = 2 AND ts >= TIMESTAMP '2024-01-05'")
def st4(spark, sf):
    s = stream(spark, sf).withColumn("project", (F.col("user_id") % 4).cast("string"))
    log = drained(spark, st.event_log(s.unionByName(s), watermark="3650 days").select("event_id", "project", "ts"))
    return st.replay(log, "2", "2024-01-05").select("event_id")


KEPT = """WITH RECURSIVE o AS (SELECT user_id AS k, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(k, n, last, event_id, kept) AS (SELECT k, n, ts, event_id, true FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, CASE WHEN epoch_us(o.ts) - epoch_us(f.last) > 7200000000 THEN o.ts ELSE f.last END, o.event_id, epoch_us(o.ts) - epoch_us(f.last) > 7200000000 FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1) SELECT k AS key, event_id FROM f WHERE kept"""


@query("st5_kept_rows", KEPT)
def st5(spark, sf):
    return drained(spark, st.kept_rows(stream(spark, sf), "user_id", 7200)).where("accepted").select("key", "event_id")


@query("st6_rate_limit", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, n, event_id, last, before, accepted) AS (SELECT user_id, n, event_id, t, CAST(NULL AS BIGINT), true FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN coalesce(o.t - before >= 3600000000, true) THEN o.t ELSE last END, CASE WHEN coalesce(o.t - before >= 3600000000, true) THEN last ELSE before END, coalesce(o.t - before >= 3600000000, true) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id AS key, event_id, accepted FROM f""")
def st6(spark, sf):
    return drained(spark, st.rate_limit(stream(spark, sf), "user_id", 2, 3600))


@query("st7_daily_rollups", "SELECT user_id AS principal_id, event_type, strftime(ts, '%Y-%m-%d') AS first_day, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 24 HOUR) FROM events) GROUP BY ALL")
def st7(spark, sf):
    out = drained(spark, st.rollups(stream(spark, sf))).withColumn("first_day", F.col("first_day").cast("string"))
    end = table(spark, sf, "events").agg(F.date_format(F.date_trunc("day", F.max("ts") - F.expr("INTERVAL '24' HOUR")), "yyyy-MM-dd").alias("e"))
    return out.join(F.broadcast(end), out["first_day"] < end["e"]).drop("e")


@query("st8_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS n FROM g GROUP BY user_id, g) SELECT user_id AS principal_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS end, n FROM s WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st8(spark, sf):
    out = drained(spark, st.sessions(stream(spark, sf), "6 hours"))
    closed = table(spark, sf, "events").agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL '1' HOUR")).alias("w"))  # what the watermark has passed
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.join(F.broadcast(closed), out["end"] <= closed["w"]).select("principal_id", day("start"), day("end"), "n")


@query("st9_every_n", "SELECT event_type AS scope, count(*) AS count FROM events GROUP BY 1 HAVING count(*) >= 50")
def st9(spark, sf):
    return drained(spark, st.every_n(stream(spark, sf), "event_type", 50))


@query("st10_incremental_links", LINKS + " SELECT source_id, target_id, overlap, delta_hours, left(sha256(source_id || '' || target_id || 'PRECEDED_BY'), 12) AS edge_id FROM l")
def st10(spark, sf):
    from engram.plans.governance import sessions

    at = folder(spark)
    rows = sessions(spark, sf)
    rows.repartition(4, "id").write.parquet(f"{at}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    st.link_new_sessions(src, f"{at}/known", f"{at}/edges", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/edges").drop("batch").distinct()
