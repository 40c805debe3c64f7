"""Telemetry, usage, budget and ordered-scan queries over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import telemetry as t
from engram.plans.registry import query, table

#: events as tool telemetry: a user is a session and a principal, users deal into four projects.
BASE = """WITH tele AS (SELECT event_id, ts AS recorded_at, user_id AS session_id, user_id AS principal_id, user_id % 4 AS project, event_type, event_type AS tool_name,
value AS duration_ms, CAST(props->>'$.k' AS BIGINT) AS tokens_in, CAST(props->>'$.k' AS BIGINT) * 2 AS tokens_out, value / 1000 AS cost_usd,
'm' || CAST(user_id % 6 AS VARCHAR) AS model_id, 'c' || CAST(event_id % 3 AS VARCHAR) AS task_category, event_type AS capability,
CASE WHEN event_id % 7 = 0 THEN 'fail' WHEN event_id % 11 = 0 THEN NULL ELSE 'pass' END AS quality_verdict, event_type = 'error' AS error FROM events)
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    verdict = F.when(F.col("event_id") % 7 == 0, "fail").when(F.col("event_id") % 11 == 0, None).otherwise("pass")
    return e.select(
        "event_id", F.col("ts").alias("recorded_at"), F.col("user_id").alias("session_id"), F.col("user_id").alias("principal_id"), (F.col("user_id") % 4).alias("project"), "event_type",
        F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), k.alias("tokens_in"), (k * 2).alias("tokens_out"), (F.col("value") / 1000).alias("cost_usd"),
        F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")).alias("model_id"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("task_category"),
        F.col("event_type").alias("capability"), verdict.alias("quality_verdict"), (F.col("event_type") == "error").alias("error"),
    )


def r(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@query("ag1_usage_rollups", BASE + """, w AS (SELECT principal_id, event_type, count(*) FILTER (CAST(recorded_at AS DATE) = DATE '2024-01-07') AS d, count(*) AS n FROM tele
WHERE recorded_at >= TIMESTAMP '2024-01-01' AND recorded_at < TIMESTAMP '2024-01-08' GROUP BY ALL)
SELECT principal_id, event_type, 'daily' AS period, d AS n, '2024-01-07' AS period_start FROM w WHERE d > 0 UNION ALL SELECT principal_id, event_type, 'weekly', n, '2024-01-01' FROM w""")
def ag1(spark, sf):
    return t.usage_rollups(telemetry(spark, sf), "2024-01-07").withColumn("period_start", F.col("period_start").cast("string"))


@query("ag2_usage_summary", BASE + """SELECT principal_id, event_type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY principal_id) AS BIGINT) AS total FROM tele
WHERE recorded_at >= TIMESTAMP '2024-01-02' AND recorded_at < TIMESTAMP '2024-01-05' GROUP BY principal_id, event_type""")
def ag2(spark, sf):
    return t.usage_summary(telemetry(spark, sf), "2024-01-04", 3).select("principal_id", "total", F.explode("by_type").alias("event_type", "n"))


@query("ag3_facets", BASE + "SELECT event_type AS value, count(*) AS n FROM tele WHERE principal_id = 7 GROUP BY ALL")
def ag3(spark, sf):
    return t.facets(telemetry(spark, sf), "event_type", 7)


@query("ag4_recent_events", BASE + "SELECT event_type, count(*) AS n FROM tele WHERE recorded_at >= TIMESTAMP '2024-01-02' AND event_type IN ('click', 'error') GROUP BY ALL")
def ag4(spark, sf):
    return telemetry(spark, sf).where(F.col("event_type").isin("click", "error") & (F.col("recorded_at") >= F.lit("2024-01-02").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("n"))


AG5 = BASE + """SELECT {key} AS period, count(*) AS calls, count(DISTINCT session_id) AS sessions, round(sum(duration_ms), 4) AS total_duration_ms, round(avg(duration_ms), 6) AS avg_duration_ms,
CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost_usd), 6) AS cost_usd FROM tele GROUP BY 1"""
for _period, _key in {"day": "strftime(recorded_at, '%Y-%m-%d')", "week": "strftime(recorded_at, '%Y-W%W')", "month": "strftime(recorded_at, '%Y-%m')", "all": "'all'"}.items():
    query(f"ag5_telemetry_by_{_period}", AG5.format(key=_key))(lambda spark, sf, p=_period: r(t.telemetry_aggregate(telemetry(spark, sf), p), total_duration_ms=4, avg_duration_ms=6, cost_usd=6))


@query("ag6_recurring_tools", BASE + "SELECT tool_name, count(DISTINCT session_id) AS sessions, count(*) AS calls FROM tele GROUP BY 1 HAVING count(DISTINCT session_id) >= 3")
def ag6(spark, sf):
    return t.recurring_tools(telemetry(spark, sf), 3)


@query("ag7_daily_metrics", BASE + "SELECT strftime(recorded_at, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(duration_ms), 4) AS total, round(avg(duration_ms), 6) AS mean, min(duration_ms) AS least, max(duration_ms) AS most FROM tele GROUP BY 1, 2")
def ag7(spark, sf):
    m = telemetry(spark, sf).groupBy(F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), "event_type")
    return m.agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 4).alias("total"), F.round(F.avg("duration_ms"), 6).alias("mean"), F.min("duration_ms").alias("least"), F.max("duration_ms").alias("most"))


BACKEND = """SELECT capability, count(*) AS n, count(latency_ms) AS measured, round(avg(latency_ms), 6) AS avg_ms, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
count(*) FILTER (error) AS errors, round(avg(CASE WHEN error THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN duration_ms END AS latency_ms FROM tele)"""


def backend_rows(spark, sf):
    return telemetry(spark, sf).withColumn("latency_ms", F.when(F.col("event_id") % 5 != 0, F.col("duration_ms")))


@query("ag8_backend_summary", BASE + BACKEND + " GROUP BY capability")
def ag8(spark, sf):
    return r(t.backend_summary(backend_rows(spark, sf)), avg_ms=6, error_rate=6)


@query("ag9_capture_summary", BASE + """SELECT event_type AS mechanism, count(*) AS total, count(*) FILTER (quality_verdict = 'pass') AS ok, count(*) FILTER (quality_verdict IS DISTINCT FROM 'pass') AS failed,
round(avg(CASE WHEN quality_verdict = 'pass' THEN 1.0 ELSE 0.0 END), 6) AS write_rate, CAST(sum(tokens_in) AS BIGINT) AS entries, event_type NOT IN ('click', 'view') AS unknown FROM tele GROUP BY 1""")
def ag9(spark, sf):
    ok = F.coalesce(F.col("quality_verdict") == "pass", F.lit(False))
    return telemetry(spark, sf).groupBy(F.col("event_type").alias("mechanism")).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("double")), 6).alias("write_rate"), F.sum("tokens_in").alias("entries")
    ).withColumn("unknown", ~F.col("mechanism").isin("click", "view"))


@query("ag10_recall_p95", BASE + """SELECT principal_id, duration_ms AS p FROM (SELECT principal_id, duration_ms, row_number() OVER (PARTITION BY principal_id ORDER BY duration_ms) - 1 AS i,
count(*) OVER (PARTITION BY principal_id) AS n FROM tele) WHERE i = CASE WHEN n <= 20 THEN n - 1 ELSE floor(n * 0.95) END""")
def ag10(spark, sf):
    return t.index_percentile(telemetry(spark, sf), ["principal_id"], "duration_ms", 0.95)


OBSERVED = """SELECT model_id, task_category, count(*) AS n, round(avg(CASE WHEN quality_verdict = 'pass' THEN 1.0 ELSE 0.0 END), 6) AS quality_rate, round(avg(cost_usd), 9) AS avg_cost_usd,
round(avg(tokens_out), 6) AS avg_tokens_out, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS last_seen,
round(avg(cost_usd) / nullif(avg(CASE WHEN quality_verdict = 'pass' THEN 1.0 ELSE 0.0 END), 0), 9) AS cost_per_pass, CASE WHEN count(*) < 5 THEN 'low' WHEN count(*) < 10 THEN 'medium' ELSE 'high' END AS confidence
FROM (SELECT *, duration_ms AS latency_ms FROM tele) GROUP BY 1, 2"""


def observed(spark, sf):
    return t.observed_models(telemetry(spark, sf).withColumn("latency_ms", F.col("duration_ms")))


@query("ag11_observed_models", BASE + OBSERVED)
def ag11(spark, sf):
    return r(observed(spark, sf).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")), quality_rate=6, avg_cost_usd=9, avg_tokens_out=6, p50_ms=6, p95_ms=6, cost_per_pass=9)


@query("ag12_budget_summary", BASE + "SELECT model_id, count(*) AS dispatches, round(sum(cost_usd), 6) AS spend, round(count(*) * 0.05 - sum(cost_usd), 6) AS saving, round(1000 - (SELECT sum(cost_usd) FROM tele), 6) AS remaining FROM tele GROUP BY 1")
def ag12(spark, sf):
    return r(t.budget_summary(telemetry(spark, sf), 0.05, 1000.0), spend=6, saving=6, remaining=6)


@query("ag14_hit_counts", BASE + "SELECT session_id AS chunk_id, count(*) AS hits FROM tele WHERE recorded_at >= TIMESTAMP '2024-01-02' AND event_type = 'click' GROUP BY 1")
def ag14(spark, sf):
    recent = telemetry(spark, sf).where((F.col("recorded_at") >= F.lit("2024-01-02").cast("timestamp_ntz")) & (F.col("event_type") == "click"))
    return recent.groupBy(F.col("session_id").alias("chunk_id")).agg(F.count("*").alias("hits"))


@query("ag15_top_projects", BASE + "SELECT project, count(*) AS n FROM tele GROUP BY 1 ORDER BY n DESC, project LIMIT 3")
def ag15(spark, sf):
    return telemetry(spark, sf).groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(3)


@query("ag16_hit_rate", BASE + "SELECT project, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type <> 'click') AS misses, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS rate, count(*) FILTER (event_type = 'click') / count(*) >= 0.8 AS on_target FROM tele GROUP BY 1")
def ag16(spark, sf):
    hit = F.col("event_type") == "click"
    return telemetry(spark, sf).groupBy("project").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.avg(hit.cast("double")), 6).alias("rate"), (F.avg(hit.cast("double")) >= 0.8).alias("on_target"))


DAILY = "daily AS (SELECT capability, CAST(recorded_at AS DATE) AS day, count(*) AS n, avg(duration_ms) AS avg_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, avg(CASE WHEN error THEN 1.0 ELSE 0.0 END) AS error_rate FROM tele GROUP BY 1, 2)"


def daily(spark, sf):
    rows = telemetry(spark, sf).withColumn("latency_ms", F.col("duration_ms"))
    return rows.groupBy("capability", t.day("recorded_at").alias("day")).agg(
        F.count("*").alias("n"), F.avg("latency_ms").alias("avg_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"), F.avg(F.col("error").cast("double")).alias("error_rate")
    )


WINDOW = "SELECT capability, CAST(sum(n) AS BIGINT) AS n, sum(avg_ms * n) / sum(n) AS avg_ms, avg(p95_ms) AS p95_ms, avg(error_rate) AS error_rate, count(DISTINCT day) AS days FROM daily WHERE day > DATE '{a}' AND day <= DATE '{b}' GROUP BY 1"


@query("ag20_weekly_window", BASE + ", " + DAILY + " SELECT capability, n, round(avg_ms, 6) AS avg_ms, round(p95_ms, 6) AS p95_ms, round(error_rate, 6) AS error_rate, days FROM (" + WINDOW.format(a="2023-12-31", b="2024-01-07") + ")")
def ag20(spark, sf):
    return r(t.weekly_window(daily(spark, sf), "2024-01-07", 7), avg_ms=6, p95_ms=6, error_rate=6)


@query("ag21_regressions", BASE + ", " + DAILY + ", a AS (" + WINDOW.format(a="2024-01-01", b="2024-01-02") + "), b AS (" + WINDOW.format(a="2023-12-31", b="2024-01-01") + """),
m AS (SELECT capability, 'p95' AS rule, (a.p95_ms - b.p95_ms) / b.p95_ms AS change, 0.2 AS lim FROM a JOIN b USING (capability) UNION ALL SELECT capability, 'errors', a.error_rate - b.error_rate, 0.05 FROM a JOIN b USING (capability)
UNION ALL SELECT capability, 'volume', (b.n - a.n) / b.n, 0.3 FROM a JOIN b USING (capability)) SELECT capability, rule, round(change, 6) AS change, CASE WHEN change > 2 * lim THEN 'alert' ELSE 'warn' END AS level FROM m WHERE change > lim""")
def ag21(spark, sf):
    d = daily(spark, sf)
    return r(t.regressions(t.weekly_window(d, "2024-01-02", 1), t.weekly_window(d, "2024-01-01", 1)).drop("lim"), change=6)


@query("ag22_cheapest_models", BASE + "SELECT task_category, count(DISTINCT model_id) AS models, round(min(c), 9) AS least_cost, arg_min(model_id, (c, model_id)) AS cheapest FROM (SELECT task_category, model_id, avg(cost_usd) AS c FROM tele GROUP BY 1, 2) GROUP BY 1")
def ag22(spark, sf):
    c = telemetry(spark, sf).groupBy("task_category", "model_id").agg(F.avg("cost_usd").alias("c"))
    return c.groupBy("task_category").agg(F.count_distinct("model_id").alias("models"), F.round(F.min("c"), 9).alias("least_cost"), F.min_by("model_id", F.struct("c", "model_id")).alias("cheapest"))


@query("ag25_health_summary", BASE + """, n AS (SELECT duration_ms, error, row_number() OVER (ORDER BY recorded_at DESC, event_id DESC) AS r FROM tele), s AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS c FROM n WHERE r <= 1000)
SELECT (SELECT count(*) FROM tele) AS records, round((SELECT avg(CASE WHEN error THEN 1.0 ELSE 0.0 END) FROM tele), 6) AS error_rate, max(CASE WHEN i = c // 2 THEN duration_ms END) AS p50, max(CASE WHEN i = CAST(floor(c * 0.95) AS BIGINT) THEN duration_ms END) AS p95 FROM s""")
def ag25(spark, sf):
    rows = telemetry(spark, sf)
    sample = rows.orderBy(F.desc("recorded_at"), F.desc("event_id")).limit(1000).agg(F.sort_array(F.collect_list("duration_ms")).alias("v"))
    n = F.size("v")
    picked = sample.select(F.get("v", F.floor(n / 2).cast("int")).alias("p50"), F.get("v", F.floor(n * 0.95).cast("int")).alias("p95"))
    return rows.agg(F.count("*").alias("records"), F.round(F.avg(F.col("error").cast("double")), 6).alias("error_rate")).crossJoin(picked)


@query("jn13_blend_priors", BASE + """, o AS (SELECT model_id, task_category, count(*) AS n, avg(CASE WHEN quality_verdict = 'pass' THEN 1.0 ELSE 0.0 END) AS q FROM tele GROUP BY 1, 2),
p AS (SELECT DISTINCT 'm' || CAST(user_id % 9 AS VARCHAR) AS model_id, 'c1' AS task_category, 0.5 AS prior FROM events)
SELECT model_id, task_category, coalesce(n, 0) AS n, round(CASE WHEN q IS NULL THEN prior WHEN prior IS NULL OR n >= 10 THEN q ELSE (n * q + 10 * prior) / (n + 10) END, 6) AS quality_rate,
CASE WHEN q IS NULL THEN 'prior' WHEN prior IS NULL OR n >= 10 THEN 'observed' ELSE 'blended' END AS source FROM o FULL JOIN p USING (model_id, task_category)""")
def jn13(spark, sf):
    priors = table(spark, sf, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 9).cast("string")).alias("model_id"), F.lit("c1").alias("task_category"), F.lit(0.5).alias("quality_rate")).distinct()
    return r(t.blend_priors(observed(spark, sf), priors), quality_rate=6)


@query("wn1_think_time", BASE + """SELECT event_id, CASE WHEN e IS NOT NULL THEN round(greatest(epoch_us(recorded_at) / 1000.0 - e, 0.0), 1) END AS think_ms FROM (SELECT *, lag(epoch_us(recorded_at) / 1000.0 + duration_ms) OVER (PARTITION BY session_id ORDER BY recorded_at, event_id) AS e FROM tele)""")
def wn1(spark, sf):
    rows = telemetry(spark, sf).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    return t.think_time(rows).select("event_id", "think_ms")


@query("wn2_latest_per_project", BASE + "SELECT project, event_id FROM tele QUALIFY row_number() OVER (PARTITION BY project ORDER BY recorded_at DESC, event_id DESC) = 1")
def wn2(spark, sf):
    return t.newest(telemetry(spark, sf), ["project"], "recorded_at", "event_id", 1).select("project", "event_id")


@query("wn3_percentile_in_pool", BASE + "SELECT event_id, round(CASE WHEN count(*) OVER w = 1 THEN CASE WHEN duration_ms > 0 THEN 1.0 ELSE 0.0 END ELSE percent_rank() OVER (PARTITION BY session_id ORDER BY duration_ms) END, 9) AS percentile FROM tele WINDOW w AS (PARTITION BY session_id)")
def wn3(spark, sf):
    from engram.operators.fusion import pool_percentile

    return pool_percentile(telemetry(spark, sf), ["session_id"], "duration_ms").select("event_id", F.round("percentile", 9).alias("percentile"))


@query("wn4_newest_signals", BASE + "SELECT event_id, event_type FROM tele QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY recorded_at DESC, event_id DESC) <= 50")
def wn4(spark, sf):
    return t.newest(telemetry(spark, sf), ["event_type"], "recorded_at", "event_id", 50).select("event_id", "event_type")


@query("wn5_size_budget", BASE + "SELECT session_id, event_id, CAST(running AS BIGINT) AS running FROM (SELECT session_id, event_id, sum(tokens_in) OVER (PARTITION BY session_id ORDER BY duration_ms DESC, event_id ROWS UNBOUNDED PRECEDING) AS running FROM tele) WHERE running <= 500")
def wn5(spark, sf):
    return t.size_budget(telemetry(spark, sf), ["session_id"], "tokens_in", "duration_ms", "event_id", 500).select("session_id", "event_id", "running")


@query("wn7_budget_ledger", BASE + "SELECT event_id, round(sum(greatest(cost_usd, 0.0)) OVER w, 6) AS spent, round(10 - sum(greatest(cost_usd, 0.0)) OVER w, 6) AS remaining FROM tele WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at, event_id ROWS UNBOUNDED PRECEDING)")
def wn7(spark, sf):
    return r(t.ledger(telemetry(spark, sf), 10.0).select("event_id", "spent", "remaining"), spent=6, remaining=6)


@query("wn8_recommendations", BASE + """, o AS (SELECT model_id, task_category, count(*) AS n, avg(CASE WHEN quality_verdict = 'pass' THEN 1.0 ELSE 0.0 END) AS q, avg(cost_usd) AS c FROM tele GROUP BY 1, 2)
SELECT task_category, model_id, round(q / (c / q), 6) AS score, row_number() OVER (PARTITION BY task_category ORDER BY round(q / (c / q), 9) DESC, round(c, 9), model_id) AS rank FROM o WHERE n >= 5 AND q > 0 AND model_id <> 'm5'""")
def wn8(spark, sf):
    from engram.operators.budget import recommend

    return r(recommend(observed(spark, sf), excluded=["m5"]).select("task_category", "model_id", "score", "rank"), score=6)


@query("wn10_export_bursts", BASE + "SELECT event_id, n AS in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY principal_id ORDER BY CAST(floor(epoch(recorded_at)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM tele) WHERE n > 2")
def wn10(spark, sf):
    return t.bursts(telemetry(spark, sf), 3600, 2).select("event_id", "in_window")


@query("wn10_sweeps", BASE + """, s AS (SELECT event_id, principal_id % 5 AS p, project, CAST(floor(epoch(recorded_at)) AS BIGINT) AS s FROM tele),
a AS (SELECT a.event_id, count(DISTINCT b.project) AS projects FROM s a JOIN s b ON a.p = b.p AND b.s BETWEEN a.s - 3600 AND a.s GROUP BY 1) SELECT event_id, projects FROM a WHERE projects >= 4""")
def wn10b(spark, sf):
    return t.sweeps(telemetry(spark, sf).withColumn("principal_id", F.col("principal_id") % 5), 3600, 4).select("event_id", F.col("projects").cast("long").alias("projects"))


@query("wn12_idle_sessions", BASE + "SELECT session_id, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS last_activity FROM tele GROUP BY 1 HAVING max(recorded_at) < TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR")
def wn12(spark, sf):
    return t.idle_sessions(telemetry(spark, sf), "2024-02-01", 24).withColumn("last_activity", F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss"))


@query("fl11_telemetry_rows", BASE + "SELECT event_id, tool_name, project FROM tele WHERE project = 1 AND tool_name = 'click' AND recorded_at >= TIMESTAMP '2024-01-01' AND recorded_at < TIMESTAMP '2024-01-20' ORDER BY recorded_at DESC, event_id LIMIT 40 OFFSET 10")
def fl11(spark, sf):
    rows = telemetry(spark, sf).where((F.col("project") == 1) & (F.col("tool_name") == "click") & F.col("recorded_at").between(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-19 23:59:59.999999").cast("timestamp_ntz")))
    return rows.orderBy(F.desc("recorded_at"), "event_id").offset(10).limit(40).select("event_id", "tool_name", "project")


@query("fl15_audit_query", BASE + "SELECT event_id FROM tele WHERE principal_id = 3 AND event_type = 'view' AND recorded_at >= TIMESTAMP '2024-01-01' ORDER BY recorded_at, event_id LIMIT 10000")
def fl15(spark, sf):
    rows = telemetry(spark, sf).where((F.col("principal_id") == 3) & (F.col("event_type") == "view") & (F.col("recorded_at") >= F.lit("2024-01-01").cast("timestamp_ntz")))
    return rows.orderBy("recorded_at", "event_id").limit(10_000).select("event_id")


@query("fl16_retention_purge", BASE + "SELECT event_id, recorded_at >= TIMESTAMP '2024-01-10' AS kept FROM tele")
def fl16(spark, sf):
    return telemetry(spark, sf).select("event_id", (F.col("recorded_at") >= F.lit("2024-01-10").cast("timestamp_ntz")).alias("kept"))


@query("so2_page_slice", BASE + "SELECT event_id, (SELECT count(*) FROM tele) AS total FROM tele ORDER BY recorded_at, event_id LIMIT 25 OFFSET 100")
def so2(spark, sf):
    rows = telemetry(spark, sf)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("recorded_at", "event_id").offset(100).limit(25).select("event_id").crossJoin(F.broadcast(total))
