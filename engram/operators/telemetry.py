"""Telemetry, usage and budget aggregates (AG) and ordered scans (WN) as DataFrame functions.

Times are UTC. A day is half-open. Percentiles: `percentile_disc` is the nearest rank, `percentile` is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bands of observed samples below which confidence is low and medium. Fixed values.
LOW_SAMPLES, MEDIUM_SAMPLES = 5, 10


def day(ts: str | Column) -> Column:
    return F.to_date(ts)


def week_key(ts: Column) -> Column:
    """Year and week of the year; weeks start on Monday, days before the first Monday are in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")
    return F.format_string("%d-W%02d", F.year(ts), week)


def period_key(ts: Column, period: str) -> Column:
    return {"day": F.date_format(ts, "yyyy-MM-dd"), "week": week_key(ts), "month": F.date_format(ts, "yyyy-MM"), "all": F.lit("all")}[period]


def usage_rollups(usage: DataFrame, on: str) -> DataFrame:
    """Counts for each principal and type on the day `on` (daily) and in the 7 days that end with it (weekly); one pass."""
    end = F.date_add(F.lit(on).cast("date"), 1)
    d = day("recorded_at")
    week = usage.where((d < end) & (d >= F.date_sub(F.lit(on).cast("date"), 6)))
    counts = week.groupBy("principal_id", "event_type").agg(F.count_if(d == F.lit(on).cast("date")).alias("daily"), F.count("*").alias("weekly"))
    stacked = counts.select("principal_id", "event_type", F.expr("stack(2, 'daily', daily, 'weekly', weekly) AS (period, n)"))
    start = F.when(F.col("period") == "daily", F.lit(on).cast("date")).otherwise(F.date_sub(F.lit(on).cast("date"), 6))
    return stacked.where("n > 0").withColumn("period_start", start)


def usage_summary(usage: DataFrame, on: str, days: int) -> DataFrame:
    """Total and by-type counts of the last `days` days, one row for each principal."""
    recent = usage.where((day("recorded_at") <= F.lit(on).cast("date")) & (day("recorded_at") > F.date_sub(F.lit(on).cast("date"), days)))
    by_type = recent.groupBy("principal_id", "event_type").agg(F.count("*").alias("n"))
    return by_type.groupBy("principal_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("by_type"))


def facets(rows: DataFrame, by: str, principal: int, allowed: tuple[str, ...] = ("event_type", "project")) -> DataFrame:
    if by not in allowed:
        raise ValueError(f"no facet {by}")
    return rows.where(F.col("principal_id") == principal).groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"))


def telemetry_aggregate(rows: DataFrame, period: str) -> DataFrame:
    return rows.groupBy(period_key(F.col("recorded_at"), period).alias("period")).agg(
        F.count("*").alias("calls"),
        F.count_distinct("session_id").alias("sessions"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def recurring_tools(rows: DataFrame, least_sessions: int) -> DataFrame:
    found = rows.groupBy("tool_name").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("calls"))
    return found.where(F.col("sessions") >= least_sessions)


def backend_summary(rows: DataFrame) -> DataFrame:
    """rows: capability, backend, latency_ms (null: not measured), error, fallbacks (array of names)."""
    return rows.groupBy("capability").agg(
        F.count("*").alias("n"),
        F.count("latency_ms").alias("measured"),
        F.avg("latency_ms").alias("avg_ms"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"),
        F.count_if("error").alias("errors"),
        F.avg(F.col("error").cast("double")).alias("error_rate"),
    )


def at_rank(value: Column, rank: Column, keys: list[str]) -> Column:
    return F.max(F.when(rank, value))


def index_percentile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The value at index int(share * n) of the sorted values; the largest if n is at most 20."""
    w = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    target = F.when(F.col("_n") <= 20, F.col("_n") - 1).otherwise(F.floor(F.col("_n") * share))
    return ranked.where(F.col("_i") == target).select(*keys, F.col(value).alias("p"))


def observed_models(rows: DataFrame) -> DataFrame:
    """Observed statistics for each model and category; cost per pass is null without a pass."""
    judged = rows.withColumn("_pass", (F.col("quality_verdict") == "pass").cast("double"))
    stats = judged.groupBy("model_id", "task_category").agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce("_pass", F.lit(0.0))).alias("quality_rate"),
        F.avg("cost_usd").alias("avg_cost_usd"),
        F.avg("tokens_out").alias("avg_tokens_out"),
        F.percentile("latency_ms", 0.5).alias("p50_ms"),
        F.percentile("latency_ms", 0.95).alias("p95_ms"),
        F.max("recorded_at").alias("last_seen"),
    )
    band = F.when(F.col("n") < LOW_SAMPLES, "low").when(F.col("n") < MEDIUM_SAMPLES, "medium").otherwise("high")
    return stats.withColumn("cost_per_pass", F.try_divide("avg_cost_usd", "quality_rate")).withColumn("confidence", band)


def blend_priors(observed: DataFrame, priors: DataFrame) -> DataFrame:
    """Below 10 samples the observed rate is blended with the prior as if the prior had 10; unmatched priors are appended."""
    o, p = observed.select("model_id", "task_category", "n", "quality_rate"), priors.select("model_id", "task_category", F.col("quality_rate").alias("_prior"))
    both = o.join(p, ["model_id", "task_category"], "full_outer")
    n, q, prior = F.coalesce("n", F.lit(0)), F.col("quality_rate"), F.col("_prior")
    rate = F.when(q.isNull(), prior).when(prior.isNull() | (n >= MEDIUM_SAMPLES), q).otherwise((n * q + 10 * prior) / (n + 10))
    source = F.when(q.isNull(), "prior").when(prior.isNull() | (n >= MEDIUM_SAMPLES), "observed").otherwise("blended")
    return both.select("model_id", "task_category", n.alias("n"), rate.alias("quality_rate"), source.alias("source"))


def budget_summary(rows: DataFrame, baseline_per_call: float, budget: float) -> DataFrame:
    per = rows.groupBy("model_id").agg(F.count("*").alias("dispatches"), F.sum("cost_usd").alias("spend"))
    total = per.agg(F.sum("spend").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("model_id", "dispatches", "spend", (F.col("dispatches") * baseline_per_call - F.col("spend")).alias("saving"), (F.lit(budget) - F.col("total")).alias("remaining"))


def think_time(rows: DataFrame) -> DataFrame:
    """Milliseconds from the end of the previous call of the session to the start of this one, 0 at least; null for the first."""
    w = Window.partitionBy("session_id").orderBy("recorded_at", "event_id")
    start = F.unix_micros("recorded_at") / 1000.0
    end = F.lag(start + F.col("duration_ms")).over(w)
    return rows.withColumn("think_ms", F.when(end.isNotNull(), F.round(F.greatest(start - end, F.lit(0.0)), 1)))


def size_budget(rows: DataFrame, group: list[str], size: str, score: str, key: str, budget: int) -> DataFrame:
    """Rows that stay when the lowest scores are dropped until the rest fits the budget."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def ledger(rows: DataFrame, budget: float) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("recorded_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    debit = F.greatest(F.col("cost_usd"), F.lit(0.0))
    return rows.withColumn("spent", F.sum(debit).over(w)).withColumn("remaining", F.lit(budget) - F.col("spent"))


def bursts(rows: DataFrame, seconds: int, more_than: int) -> DataFrame:
    """Rows at which a principal has more than so many events in the seconds up to and including this one."""
    w = Window.partitionBy("principal_id").orderBy("_s").rangeBetween(-seconds, 0)
    timed = rows.withColumn("_s", F.unix_seconds(F.col("recorded_at").cast("timestamp")))
    return timed.withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") > more_than).drop("_s")


def sweeps(rows: DataFrame, seconds: int, least: int) -> DataFrame:
    """Rows at which a principal has touched at least so many projects in the window."""
    w = Window.partitionBy("principal_id").orderBy("_s").rangeBetween(-seconds, 0)
    timed = rows.withColumn("_s", F.unix_seconds(F.col("recorded_at").cast("timestamp")))
    return timed.withColumn("projects", F.size(F.collect_set("project").over(w))).where(F.col("projects") >= least).drop("_s")


def idle_sessions(rows: DataFrame, now: str, hours: float) -> DataFrame:
    last = rows.groupBy("session_id").agg(F.max("recorded_at").alias("last_activity"))
    return last.where(F.col("last_activity") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND"))


def newest(rows: DataFrame, group: list[str], order: str, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(order), F.desc(key))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def weekly_window(daily: DataFrame, end: str, days: int) -> DataFrame:
    """daily: capability, day, n, avg_ms, p95_ms, error_rate; merged over the days up to `end`."""
    d = F.lit(end).cast("date")
    rows = daily.where((F.col("day") <= d) & (F.col("day") > F.date_sub(d, days)))
    return rows.groupBy("capability").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("avg_ms") * F.col("n")) / F.sum("n")).alias("avg_ms"),
        F.avg("p95_ms").alias("p95_ms"),
        F.avg("error_rate").alias("error_rate"),
        F.count_distinct("day").alias("days"),
    )


def regressions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Findings of one window against an earlier one: p95 +20 %, error rate +5 points, volume -30 %; alert at twice the limit."""
    b = before.select("capability", F.col("n").alias("n0"), F.col("p95_ms").alias("p0"), F.col("error_rate").alias("e0"))
    both = now.join(b, "capability")
    measured = both.select("capability", F.expr("stack(3, 'p95', try_divide(p95_ms - p0, p0), 0.2D, 'errors', error_rate - e0, 0.05D, 'volume', try_divide(n0 - n, CAST(n0 AS DOUBLE)), 0.3D) AS (rule, change, lim)"))
    return measured.where("change > lim").withColumn("level", F.when(F.col("change") > 2 * F.col("lim"), "alert").otherwise("warn"))


def recall_aggregate(events: DataFrame) -> DataFrame:
    """events (event_id, mode, version, latency_ms, results) as one row: total_events, total, average and p95 latency (by index int(0.95 n), the maximum up to 20), average result
    count, and histograms of modes (null: unknown) and versions (null and empty don't count) as name=count, sorted. No events: zero and nulls."""
    from engram.operators.ranking import global_rank

    timed = events.where("latency_ms IS NOT NULL")
    n = timed.count()
    place = n - 1 if n <= 20 else n * 95 // 100
    p95 = global_rank(timed.select("event_id", "latency_ms"), "latency_ms", "event_id").where(F.col("rank") == place).agg(F.max("latency_ms").alias("p95_latency_ms"))
    facts = events.agg(F.count("*").alias("total_events"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total_latency_ms"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg("results").alias("avg_result_count"))

    def histogram(column, name: str) -> DataFrame:
        counts = events.select(column.alias("k")).where("k IS NOT NULL AND k <> ''").groupBy("k").agg(F.count("*").alias("c"))
        return counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", F.col("c").cast("string")))), ",").alias(name))

    one = facts
    for other in (p95, histogram(F.coalesce("mode", F.lit("unknown")), "modes"), histogram(F.col("version"), "versions")):
        one = one.crossJoin(F.broadcast(other))  # one row each
    return one


def table_counts(**tables: DataFrame) -> DataFrame:
    """(table, records): one count a table."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("records")).select(F.lit(name).alias("table"), "records") for name, df in tables.items()])
