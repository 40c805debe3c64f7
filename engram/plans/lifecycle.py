"""Lifecycle, evaluation and ordered-fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import evaluation as ev
from engram.operators import extraction as ex
from engram.operators import folds
from engram.operators import lifecycle as lc
from engram.operators.fusion import ranked
from engram.plans.registry import query, table
from engram.plans.retrieval import STOP

MEM = """WITH mem AS (SELECT doc_id AS stem, lang AS project, text AS content, (doc_id % 11) / 10 AS importance, (doc_id % 50) / 10 AS salience, doc_id % 13 = 0 AS pinned, CASE WHEN doc_id % 17 = 0 THEN DATE '2026-01-10' ELSE DATE '2026-01-01' END AS last_decay,
doc_id % 200 AS age, doc_id % 19 = 0 AS superseded, CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'active' END AS status FROM documents),
rc AS (SELECT DISTINCT CAST(props->>'$.k' AS BIGINT) AS stem FROM events),
dc AS (SELECT *, CASE WHEN pinned THEN 'pinned' WHEN last_decay >= DATE '2026-01-10' THEN 'already_decayed' WHEN n < 0.05 THEN 'archived' ELSE 'decayed' END AS outcome FROM (SELECT *, least(greatest(salience * pow(1 - CASE WHEN importance >= 0.8 THEN 0.01 WHEN importance >= 0.5 THEN 0.02 ELSE 0.05 END::DOUBLE, 9), 0), 5) AS n FROM mem))
"""


def mem(spark, sf):
    d, m = table(spark, sf, "documents"), F.col("doc_id")
    return d.select(
        m.alias("stem"), F.col("lang").alias("project"), F.col("text").alias("content"), ((m % 11) / 10).alias("importance"), ((m % 50) / 10).alias("salience"), (m % 13 == 0).alias("pinned"),
        F.when(m % 17 == 0, "2026-01-10").otherwise("2026-01-01").cast("date").alias("last_decay"), (m % 200).alias("age"), (m % 19 == 0).alias("superseded"), F.when(m % 3 == 0, "stale").otherwise("active").alias("status"),
    )


def recalled(spark, sf):
    return table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("stem")).distinct()


@query("lc1_decay", MEM + "SELECT stem, outcome, round(CASE WHEN outcome IN ('decayed', 'archived') THEN n ELSE salience END, 6) AS salience FROM dc")
def lc1(spark, sf):
    return lc.decay(mem(spark, sf), 9, "2026-01-10").select("stem", "outcome", F.round("salience", 6).alias("salience"))


@query("lc2_prune_candidates", MEM + "SELECT stem, CASE WHEN superseded AND age >= 7 THEN 'superseded' ELSE 'age' END AS reason, age FROM mem WHERE NOT pinned AND ((superseded AND age >= 7) OR age > 90) AND stem NOT IN (SELECT stem FROM rc)")
def lc2(spark, sf):
    return lc.prune_candidates(mem(spark, sf), recalled(spark, sf)).select("stem", "reason", "age")


@query("lc3_hygiene", MEM + """, c AS (SELECT *, row_number() OVER (PARTITION BY project, sha256(content) ORDER BY stem) > 1 AS dup FROM dc), p AS (SELECT *, NOT pinned AND (((superseded OR dup) AND age >= 7) OR age > 90) AND stem NOT IN (SELECT stem FROM rc) AS gone FROM c)
SELECT project, count(*) AS files, count(*) FILTER (outcome = 'decayed') AS decayed, count(*) FILTER (outcome = 'archived') AS archived, count(*) FILTER (dup) AS duplicates, count(*) FILTER (gone) AS pruned FROM p GROUP BY 1""")
def lc3(spark, sf):
    return lc.hygiene(mem(spark, sf), recalled(spark, sf), 9, "2026-01-10")


@query("lc4_memory_state", "SELECT user_id AS memory_id, CASE WHEN bool_or(event_type = 'error') THEN 'superseded' ELSE 'active' END AS status, CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS verifications, round(least(0.7::DOUBLE + 0.05::DOUBLE * count(*) FILTER (event_type = 'click'), 1.0::DOUBLE), 6) AS confidence, count(*) AS events FROM events GROUP BY 1")
def lc4(spark, sf):
    kind = F.when(F.col("event_type") == "click", "verified").when(F.col("event_type") == "error", "superseded").otherwise("other")
    e = table(spark, sf, "events").select(F.col("user_id").alias("memory_id"), kind.alias("event_type"), "ts", "event_id")
    return lc.fold_events(e).withColumn("confidence", F.round("confidence", 6))


@query("lc5_recall_feedback", """WITH r AS (SELECT user_id AS recall_id, min(ts) AS t FROM events GROUP BY 1), f AS (SELECT e.user_id AS recall_id, CAST(props->>'$.k' AS BIGINT) AS chunk, CAST(props->>'$.k' AS BIGINT) % 7 AS file, ts, event_id, event_type = 'click' AS used FROM events e),
k AS (SELECT * FROM f JOIN r USING (recall_id) WHERE ts <= t + INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY recall_id, chunk ORDER BY ts, event_id) = 1)
SELECT file, round(least(greatest(sum(CASE WHEN used THEN 0.1::DOUBLE ELSE -0.05::DOUBLE END), -1), 1), 6) AS delta, count(*) FILTER (used) AS used, count(*) FILTER (NOT used) AS ignored FROM k GROUP BY 1""")
def lc5(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events")
    f = e.select(F.col("user_id").alias("recall_id"), k.alias("chunk_id"), (k % 7).alias("file"), "ts", "event_id", (F.col("event_type") == "click").alias("used"))
    return lc.recall_feedback(f, e.groupBy(F.col("user_id").alias("recall_id")).agg(F.min("ts").alias("ts"))).withColumn("delta", F.round("delta", 6))


@query("lc6_score_override", MEM + ", c AS (SELECT CAST(props->>'$.k' AS BIGINT) AS stem, arg_max(value / 20, event_id) AS v FROM events GROUP BY 1) SELECT stem, round(CASE WHEN v IS NULL THEN importance ELSE least(greatest(v, 0), 1) END, 6) AS importance FROM mem LEFT JOIN c USING (stem)")
def lc6(spark, sf):
    c = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("stem"), (F.col("value") / 20).alias("importance"), F.col("event_id").alias("ts"))
    return lc.override(mem(spark, sf), c, "stem", "importance", 0.0, 1.0).select("stem", F.round("importance", 6).alias("importance"))


@query("lc7_decision_records", "SELECT doc_id, 'decision-' || left(sha256(text), 12) AS record_id, '[' || lang || '] ' || source AS title FROM documents")
def lc7(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("decision-"), F.substring(F.sha2("text", 256), 1, 12)).alias("record_id"), F.format_string("[%s] %s", "lang", "source").alias("title"))


@query("lc8_alerts", MEM + "SELECT stem, project FROM mem WHERE importance >= 0.8")
def lc8(spark, sf):
    return mem(spark, sf).where("importance >= 0.8").select("stem", "project")


@query("lc9_quarantine", """WITH a AS (SELECT event_id % 4001 AS doc, ts, event_type = 'purchase' AS ok FROM events) SELECT doc, count(*) FILTER (NOT ok) AS failures, CASE WHEN bool_or(ok) THEN 'done' WHEN count(*) FILTER (NOT ok) >= 3 THEN 'exhausted' WHEN max(ts) + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-20' THEN 'retryable' ELSE 'waiting' END AS state FROM a GROUP BY 1""")
def lc9(spark, sf):
    a = table(spark, sf, "events").select((F.col("event_id") % 4001).alias("doc"), "ts", (F.col("event_type") == "purchase").alias("ok"))
    return lc.quarantine(a, F.lit("2024-01-20").cast("timestamp_ntz")).select("doc", "failures", "state")


@query("lc10_backfill_acl", "SELECT doc_id, doc_id % 4 = 0 OR doc_id % 6 = 0 AS filled, CASE WHEN doc_id % 4 = 0 THEN 'team' ELSE lang END AS acl, CASE WHEN doc_id % 6 = 0 THEN 'internal' ELSE 'public' END AS classification FROM documents")
def lc10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.array("lang")).alias("acl_allow"), F.when(F.col("doc_id") % 6 != 0, "public").alias("classification"))
    return lc.backfill_acl(d, ["team"], "internal").select("doc_id", "filled", F.array_join("acl_allow", ",").alias("acl"), "classification")


@query("ag24_archive_candidates", MEM + "SELECT stem FROM mem WHERE status = 'stale' AND NOT pinned AND age > 180")
def ag24(spark, sf):
    return lc.archive_candidates(mem(spark, sf)).select("stem")


@query("snk3_upsert", "SELECT c_custkey, c_nationkey AS created, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT c_custkey + 1000000, -1, c_acctbal + 2 FROM customer WHERE c_custkey % 50 = 0")
def snk3(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("created"), F.col("c_acctbal").alias("balance"))
    new = c.where("c_custkey % 3 = 0").unionByName(c.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)).withColumn("created", F.lit(-1))
    changes = new.withColumn("balance", F.col("balance") + 1).withColumn("at", F.lit(1)).unionByName(new.withColumn("balance", F.col("balance") + 2).withColumn("at", F.lit(2)))
    return lc.upsert(c, changes, "c_custkey", ["created"], "at")


@query("snk2_rollup_replace", "SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day, count(*) AS n FROM events GROUP BY ALL")
def snk2(spark, sf):
    from engram.sources.sinks import replace_rollups

    e = table(spark, sf, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "event_id")
    stale = e.where("event_id % 2 = 0").groupBy("user_id", "day").agg(F.count("*").alias("n")).withColumn("computed_at", F.lit(1))
    fresh = e.groupBy("user_id", "day").agg(F.count("*").alias("n")).withColumn("computed_at", F.lit(2))
    return replace_rollups(stale, fresh, ["user_id", "day"], "computed_at").select("user_id", F.col("day").cast("long").alias("day"), "n")


@query("snk4_gated_export", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1)")
def snk4(spark, sf):
    from engram.operators.filters import LEVELS, export_decisions, export_matrix

    d = table(spark, sf, "documents").withColumn("level", F.get(F.array(*[F.lit(x) for x in LEVELS]), (F.col("doc_id") % 4).cast("int")))
    rows = d.select("doc_id", "level", F.lit("csv").alias("format"), F.lit(None).cast("string").alias("token"))
    return export_decisions(rows, export_matrix(spark)).where("allowed").select("doc_id")


@query("snk5_discovery_document", "SELECT project, '# ' || project || chr(10) || string_agg('- ' || CAST(stem AS VARCHAR), chr(10) ORDER BY stem) AS body, max(importance) AS importance FROM (" + MEM.replace("WITH mem", "WITH mem", 1) + "SELECT * FROM mem) GROUP BY 1")
def snk5(spark, sf):
    from engram.sources.sinks import discovery_documents

    return discovery_documents(mem(spark, sf).select("project", "stem", F.col("stem").cast("string").alias("entry"), F.col("importance").alias("confidence")), "stem").select("project", "body", "importance")


# --- evaluation --------------------------------------------------------------

EVAL = """WITH j AS (SELECT doc_id % 40 AS query_id, doc_id AS id, quality + 2 * (1 - toxic) AS gain FROM labels WHERE quality + 2 * (1 - toxic) > 0), h AS (SELECT doc_id % 40 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY (doc_id * 7919) % 1009, doc_id) AS rank FROM documents),
i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN n <= 10 THEN gain / log2(n + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, id) AS n FROM j) GROUP BY 1),
g AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(gain / log2(rank + 1)) AS dcg FROM h JOIN j USING (query_id, id) WHERE rank <= 10 GROUP BY 1),
m AS (SELECT query_id, coalesce(found, 0) / 10 AS precision, CAST(coalesce(found, 0) > 0 AS INTEGER) AS hit, coalesce(found, 0) / relevant AS recall, coalesce(1 / first, 0) AS mrr, coalesce(dcg / ideal, 0) AS ndcg FROM i LEFT JOIN g USING (query_id))
"""


def metrics(spark, sf, a=7919):
    gain = F.coalesce(F.col("quality"), F.lit(0)) + 2 * (1 - F.coalesce(F.col("toxic"), F.lit(1)))
    j = table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"), gain.alias("gain"))
    h = table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"), (-((F.col("doc_id") * a) % 1009)).alias("score"))
    return ev.ranking_metrics(ranked(h), j, 10)


@query("ev1_ranking_metrics", EVAL + "SELECT query_id, round(precision, 6) AS precision, hit, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def ev1(spark, sf):
    return metrics(spark, sf).select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query("ev2_percentiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def ev2(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.25), 6).alias("p25"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query("ev3_category_stats", "SELECT event_type AS category, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n FROM events GROUP BY 1")
def ev3(spark, sf):
    s = ev.category_stats(table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("value").alias("score")))
    return s.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


#: Draws of 5000 resamples by hash, as the operator states them.
BOOT = """, v AS (SELECT {x} AS x FROM {rows}), gr AS (SELECT list_sort(list(x)) AS xs, avg(x) AS mean, count(*) AS n FROM v), b AS (SELECT unnest(range(1, 5001)) AS b),
bm AS (SELECT b, avg(xs[1 + CAST(('0x' || left(md5('7:' || CAST(b AS VARCHAR) || ':' || CAST(d AS VARCHAR)), 8)) AS BIGINT) % n]) AS m FROM b, (SELECT *, unnest(range(1, n + 1)) AS d FROM gr) GROUP BY b),
e AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm) SELECT 'ndcg' AS grp, round(mean, 6) AS mean, n, round(low, 6) AS low, round(high, 6) AS high"""
RIVAL = ", h2 AS (SELECT doc_id % 40 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY (doc_id * 104729) % 1009, doc_id) AS rank FROM documents), g2 AS (SELECT query_id, sum(gain / log2(rank + 1)) AS dcg FROM h2 JOIN j USING (query_id, id) WHERE rank <= 10 GROUP BY 1), m2 AS (SELECT query_id, coalesce(g2.dcg / ideal, 0) AS n2 FROM i LEFT JOIN g2 USING (query_id))"


def interval(ci):
    return ci.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query("ev4_bootstrap_mean", EVAL + BOOT.format(x="ndcg", rows="m") + " FROM gr, e")
def ev4(spark, sf):
    return interval(ev.bootstrap_mean(metrics(spark, sf).select(F.lit("ndcg").alias("grp"), F.col("ndcg").alias("x"))))


@query("ev5_delta_verdict", EVAL + RIVAL + BOOT.format(x="n2 - ndcg", rows="m JOIN m2 USING (query_id)") + ", CASE WHEN n < 5 THEN 'insufficient' WHEN low > 0 THEN 'improved' WHEN high < 0 THEN 'regressed' ELSE 'parity' END AS verdict FROM gr, e")
def ev5(spark, sf):
    a, b = metrics(spark, sf), metrics(spark, sf, 104729)
    d = a.select("query_id", F.col("ndcg").alias("x")).join(b.select("query_id", F.col("ndcg").alias("y")), "query_id")
    ci = ev.bootstrap_mean(d.select(F.lit("ndcg").alias("grp"), (F.col("y") - F.col("x")).alias("x")))
    return interval(ci.withColumn("verdict", ev.delta_verdict(F.col("low"), F.col("high"), F.col("n"))))


#: Poisson weights of 5000 resamples by counter, as the operator states them.
WEIGHTS = """, v AS (SELECT query_id AS key, {x} AS x FROM {rows}), z0 AS (SELECT b, x, xor((((key % 18446744073709551616)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT), (b + 7000021)::UHUGEINT) AS z FROM v, range(1, 5001) t(b)),
z1 AS (SELECT b, x, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM z0), z2 AS (SELECT b, x, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM z1),
w AS (SELECT b, x, (xor(z, z >> 31) >> 32)::BIGINT AS u FROM z2), pw AS (SELECT b, x, len(list_filter({cuts}, lambda c: c <= u)) AS w FROM w),
bm AS (SELECT b, sum(w * x) / sum(w) AS m FROM pw GROUP BY b HAVING sum(w) > 0), e AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm), gr AS (SELECT avg(x) AS mean, count(*) AS n FROM v)
SELECT 'ndcg' AS grp, round(mean, 6) AS mean, n, round(low, 6) AS low, round(high, 6) AS high"""


@query("ev4_mergeable_bootstrap", EVAL + WEIGHTS.format(x="ndcg", rows="m", cuts=ev.POISSON) + " FROM gr, e")
def ev4b(spark, sf):
    return interval(ev.bootstrap_sums(metrics(spark, sf).select(F.lit("ndcg").alias("grp"), F.col("query_id").alias("key"), F.col("ndcg").alias("x"))))


@query("ev5_mergeable_delta", EVAL + RIVAL + WEIGHTS.format(x="n2 - ndcg", rows="m JOIN m2 USING (query_id)", cuts=ev.POISSON) + ", CASE WHEN n < 5 THEN 'insufficient' WHEN low > 0 THEN 'improved' WHEN high < 0 THEN 'regressed' ELSE 'parity' END AS verdict FROM gr, e")
def ev5b(spark, sf):
    a, b = metrics(spark, sf), metrics(spark, sf, 104729)
    d = a.select("query_id", F.col("ndcg").alias("x")).join(b.select("query_id", F.col("ndcg").alias("y")), "query_id")
    ci = ev.bootstrap_sums(d.select(F.lit("ndcg").alias("grp"), F.col("query_id").alias("key"), (F.col("y") - F.col("x")).alias("x")))
    return interval(ci.withColumn("verdict", ev.delta_verdict(F.col("low"), F.col("high"), F.col("n"))))


PAIRS = "WITH p AS (SELECT user_id AS grp, value AS a, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), d AS (SELECT grp, round(a - b, 9) AS d FROM p WHERE b IS NOT NULL), r AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (count(*) OVER (PARTITION BY grp, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY grp, abs(d)) AS t FROM d WHERE d <> 0)"


def pairs(spark, sf):
    from pyspark.sql import Window

    b = F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("value").alias("a"), b.alias("b")).where("b IS NOT NULL")


RANKS = " SELECT grp, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, CAST(sum(t * t - 1) AS BIGINT) AS ties, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY 1"


@query("ev6_signed_rank", PAIRS + RANKS)
def ev6(spark, sf):
    return ev.signed_rank(pairs(spark, sf))


#: ways: how many subsets of the ranks 1 to n have each sum; the error function as a series of positive terms.
EV6_P = (PAIRS.replace("WITH p", "WITH RECURSIVE p", 1) + ", g AS (" + RANKS + """), ways(n, c) AS (SELECT 0, [1::BIGINT] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda s: coalesce(c[s + 1], 0) + CASE WHEN s > n THEN coalesce(c[s - n], 0) ELSE 0 END) FROM ways WHERE n < 25),
z AS (SELECT g.*, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS v FROM g), x AS (SELECT z.*, CASE WHEN v > 0 THEN (abs(w - n * (n + 1) / 4) - 0.5) / sqrt(2 * v) ELSE 0 END AS x FROM z)
SELECT grp, x.n, w_plus, w_minus, ties, w, round(CASE WHEN x.n <= 25 AND ties = 0 THEN least(1, 2 * list_sum(c[1:CAST(floor(w) AS BIGINT) + 1]) / pow(2, x.n)) WHEN x <= 0 THEN 1 WHEN x > 6 THEN 0
 ELSE 1 - list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(x) - lgamma(k + 1.5) - x * x))) END, 6) AS p FROM x LEFT JOIN ways ON ways.n = x.n""")


@query("ev6_signed_rank_p", EV6_P)
def ev6p(spark, sf):
    return ev.signed_rank_p(ev.signed_rank(pairs(spark, sf))).withColumn("p", F.round("p", 6))


BOW = r"""WITH w AS (SELECT conv_id AS file, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations), b AS (SELECT file, turn, w, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT file, turn, sqrt(sum(c * c)) AS n FROM b GROUP BY ALL),
s AS (SELECT x.file, x.turn AS i, y.turn AS j, sum(x.c * y.c) / any_value(p.n) / any_value(q.n) AS sim FROM b x JOIN b y ON x.file = y.file AND x.w = y.w AND x.turn % 2 = 0 AND y.turn % 2 = 1 JOIN n p ON p.file = x.file AND p.turn = x.turn JOIN n q ON q.file = y.file AND q.turn = y.turn GROUP BY ALL)"""


MATCHES = BOW.replace("WITH w AS", "WITH RECURSIVE w AS") + """, o AS (SELECT file, i, j, row_number() OVER (PARTITION BY file ORDER BY round(sim, 9) DESC, i, j) AS n FROM s WHERE sim >= 0.2),
f(file, n, a, b) AS (SELECT file, n, [i], [j] FROM o WHERE n = 1 UNION ALL SELECT o.file, o.n, CASE WHEN list_contains(a, o.i) OR list_contains(b, o.j) THEN a ELSE list_append(a, o.i) END, CASE WHEN list_contains(a, o.i) OR list_contains(b, o.j) THEN b ELSE list_append(b, o.j) END FROM f JOIN o ON o.file = f.file AND o.n = f.n + 1),
t AS (SELECT file, max(len(a)) AS tp FROM f GROUP BY 1) SELECT conv_id AS file, coalesce(any_value(tp), 0) AS tp, count(*) FILTER (turn % 2 = 1) - coalesce(any_value(tp), 0) AS fp, count(*) FILTER (turn % 2 = 0) - coalesce(any_value(tp), 0) AS fn FROM conversations LEFT JOIN t ON t.file = conv_id GROUP BY 1"""


@query("ev7_greedy_matches", MATCHES)
def ev7(spark, sf):
    c = table(spark, sf, "conversations")
    want = c.where("turn % 2 = 0").select(F.col("conv_id").alias("file"), F.col("turn").alias("i"), "text")
    got = c.where("turn % 2 = 1").select(F.col("conv_id").alias("file"), F.col("turn").alias("j"), "text")
    return ev.greedy_matches(want, got, 0.2)


@query("ev8_missed_targets", BOW + " SELECT c.conv_id AS file, c.turn AS i, round(coalesce(max(sim), 0), 6) AS best FROM conversations c LEFT JOIN s ON s.file = c.conv_id AND s.i = c.turn WHERE c.turn % 2 = 0 GROUP BY ALL")
def ev8(spark, sf):
    c = table(spark, sf, "conversations")
    best = ev.best_similarity(c.where("turn % 2 = 0").select(F.col("conv_id").alias("file"), F.col("turn").alias("i"), "text"), c.where("turn % 2 = 1").select(F.col("conv_id").alias("file"), F.col("turn").alias("j"), "text"))
    return best.withColumn("best", F.round("best", 6))


@query("ev9_dedup_rates", BOW + " SELECT round(avg(CASE WHEN j = i + 1 THEN CAST(sim >= 0.3 AS INTEGER)::DOUBLE END), 6) AS true_hit, round(avg(CASE WHEN j <> i + 1 THEN CAST(sim >= 0.3 AS INTEGER)::DOUBLE END), 6) AS false_dedup FROM s")
def ev9(spark, sf):
    c = table(spark, sf, "conversations")
    sim = ev.bow_cosine(c.where("turn % 2 = 0").select(F.col("conv_id").alias("file"), F.col("turn").alias("i"), "text"), c.where("turn % 2 = 1").select(F.col("conv_id").alias("file"), F.col("turn").alias("j"), "text"))
    label = F.when(F.col("j") == F.col("i") + 1, "true-dup").otherwise("false-dup")
    return ev.dedup_rates(sim.withColumn("label", label), 0.3).select(F.round("true_hit", 6).alias("true_hit"), F.round("false_dedup", 6).alias("false_dedup"))


@query("ev10_benchmark_regressions", "WITH b AS (SELECT user_id AS metric, avg(value) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id AS metric, avg(value) AS now FROM events WHERE event_id % 2 = 1 AND user_id % 9 <> 0 GROUP BY 1) SELECT metric, CASE WHEN base <= 0 THEN 'skipped' WHEN now IS NULL THEN 'missing' WHEN (now - base) / base > 0.2 THEN 'slower' ELSE 'ok' END AS verdict FROM b LEFT JOIN n USING (metric)")
def ev10(spark, sf):
    e = table(spark, sf, "events")
    mean = lambda d: d.groupBy(F.col("user_id").alias("metric")).agg(F.avg("value").alias("value"))
    return ev.benchmark_regressions(mean(e.where("event_id % 2 = 0")), mean(e.where("event_id % 2 = 1 AND user_id % 9 <> 0")))


@query("ev11_win_rate", EVAL + ", h2 AS (SELECT doc_id % 40 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY (doc_id * 104729) % 1009, doc_id) AS rank FROM documents), g2 AS (SELECT query_id, sum(gain / log2(rank + 1)) AS dcg FROM h2 JOIN j USING (query_id, id) WHERE rank <= 10 GROUP BY 1), m2 AS (SELECT query_id, coalesce(g2.dcg / ideal, 0) AS n2 FROM i LEFT JOIN g2 USING (query_id)) SELECT round(avg(CAST(m.ndcg > n2 AS INTEGER)::DOUBLE), 6) AS win_rate, count(*) AS n FROM m JOIN m2 USING (query_id)")
def ev11(spark, sf):
    return ev.win_rate(metrics(spark, sf), metrics(spark, sf, 104729), "ndcg").withColumn("win_rate", F.round("win_rate", 6))


# --- ordered folds -----------------------------------------------------------


@query("wn9_kept_rows", """WITH RECURSIVE o AS (SELECT user_id AS k, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(k, n, last, event_id, kept) AS (SELECT k, n, ts, event_id, true FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, CASE WHEN epoch_us(o.ts) - epoch_us(f.last) > 1800000000 THEN o.ts ELSE f.last END, o.event_id, epoch_us(o.ts) - epoch_us(f.last) > 1800000000 FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1) SELECT k, event_id FROM f WHERE kept""")
def wn9(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("user_id"))
    return folds.kept_rows(e, ["k"], 1800)


@query("wn11_rate_limit", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, n, event_id, last, before, accepted) AS (SELECT user_id, n, event_id, t, CAST(NULL AS BIGINT), true FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN coalesce(o.t - before >= 3600000000, true) THEN o.t ELSE last END, CASE WHEN coalesce(o.t - before >= 3600000000, true) THEN last ELSE before END, coalesce(o.t - before >= 3600000000, true) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, event_id, accepted FROM f""")
def wn11(spark, sf):
    return folds.rate_limited(table(spark, sf, "events"), "user_id", 2, 3600)


@query("wn6_greedy_fit", """WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 13 <> 0, -n_chars % 101, doc_id) AS n FROM documents),
f(lang, n, used, doc_id, fits) AS (SELECT lang, n, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END, doc_id, n_chars <= 20000 FROM o WHERE n = 1 UNION ALL SELECT o.lang, o.n, CASE WHEN used + n_chars <= 20000 THEN used + n_chars ELSE used END, o.doc_id, used + n_chars <= 20000 FROM f JOIN o ON o.lang = f.lang AND o.n = f.n + 1)
SELECT lang, doc_id FROM f WHERE fits""")
def wn6(spark, sf):
    d = table(spark, sf, "documents")
    return folds.greedy_fit(d, "lang", "n_chars", 20_000, [F.col("doc_id") % 13 != 0, -F.col("n_chars") % 101], "doc_id")


@query("rk24_chunk_state", """WITH RECURSIVE o AS (SELECT label AS stream, vec_id AS pos, CASE WHEN vec_id % 5 <> 0 THEN embedding::DOUBLE[] END AS e, (vec_id % 10) / 10 AS score, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f(stream, n, pos, total, topic, drift) AS (SELECT stream, n, pos, score, list_transform(e, lambda v: v / 2), false FROM o WHERE n = 1
UNION ALL SELECT o.stream, o.n, o.pos, total + o.score, CASE WHEN o.e IS NULL THEN topic WHEN topic IS NULL THEN list_transform(o.e, lambda v: v / (o.n + 1)) ELSE list_transform(list_zip(topic, o.e), lambda z: z[1] + (z[2] - z[1]) / (o.n + 1)) END,
  o.e IS NOT NULL AND topic IS NOT NULL AND coalesce(list_cosine_similarity(topic, o.e) < 0.3, false) FROM f JOIN o ON o.stream = f.stream AND o.n = f.n + 1)
SELECT stream, pos, n AS seen, round(total / n, 6) AS mean_score, drift, round(coalesce(sqrt(list_inner_product(topic, topic)), 0), 6) AS topic_norm FROM f""")
def rk24(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("stream"), F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"), ((F.col("vec_id") % 10) / 10).alias("score"))
    return folds.chunk_state(e, "stream", "pos").withColumns({c: F.round(c, 6) for c in ("mean_score", "topic_norm")})


@query("rk24_boundaries", """WITH RECURSIVE o AS (SELECT label AS stream, vec_id AS pos, CASE WHEN vec_id % 5 <> 0 THEN embedding::DOUBLE[] END AS e, (vec_id % 10) / 10 AS score, CASE WHEN vec_id % 7 <> 0 THEN ['Node ' || vec_id % 13, ' node ' || vec_id % 4 || ' ', '', 'e' || vec_id % 37] END AS ents,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f(stream, n, pos, low, high, total, topic, drift, held) AS (SELECT stream, n, pos, score, score, score, list_transform(e, lambda v: v / 2), false, list_filter(list_transform(coalesce(ents, []), lambda x: trim(x)), lambda x: x <> '') FROM o WHERE n = 1
UNION ALL SELECT o.stream, o.n, o.pos, least(low, o.score), greatest(high, o.score), total + o.score, CASE WHEN o.e IS NULL THEN topic WHEN topic IS NULL THEN list_transform(o.e, lambda v: v / (o.n + 1)) ELSE list_transform(list_zip(topic, o.e), lambda z: z[1] + (z[2] - z[1]) / (o.n + 1)) END,
  o.e IS NOT NULL AND (topic IS NULL OR list_cosine_similarity(topic, o.e) < 0.3),
  list_concat(list_filter(list_transform(coalesce(o.ents, []), lambda x: trim(x)), lambda x: x <> ''), held)[1:60] FROM f JOIN o ON o.stream = f.stream AND o.n = f.n + 1),
d AS (SELECT *, list_filter(held, lambda x, i: list_position(list_transform(held, lambda y: lower(y)), lower(x)) = i)[1:8] AS kept FROM f)
SELECT stream, pos, n AS seen, drift, low AS score_min, high AS score_max, round(total / n, 6) AS score_mean, round(greatest(0.1, 0.95 ** n), 6) AS decay, array_to_string(kept, '|') AS entities, round(coalesce(sqrt(list_inner_product(topic, topic)), 0), 6) AS topic_norm FROM d""")
def rk24b(spark, sf):
    from engram.functions.vectors import norm

    m = F.col("vec_id")
    text = lambda p, n, q="": F.concat(F.lit(p), (m % n).cast("string"), F.lit(q))
    names = F.when(m % 7 != 0, F.array(text("Node ", 13), text(" node ", 4, " "), F.lit(""), text("e", 37)))
    e = table(spark, sf, "embeddings").select(F.col("label").alias("stream"), m.alias("pos"), F.when(m % 5 != 0, F.col("embedding")).alias("embedding"), ((m % 10) / 10).alias("score"), names.alias("entities"))
    b = folds.chunk_boundaries(e, "stream", "pos", most=8)
    return b.select("stream", "pos", "seen", "drift", "score_min", "score_max", F.round("score_mean", 6).alias("score_mean"), F.round("decay", 6).alias("decay"), F.array_join("entities_kept", "|").alias("entities"), F.round(F.coalesce(norm(F.col("topic")), F.lit(0.0)), 6).alias("topic_norm"))


@query("rk30_compaction", r"""WITH t AS (SELECT item_id AS task_id, list_distinct(list_filter(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9_]+')), lambda x: x NOT IN (""" + STOP + r"""))) AS w FROM benchmark),
s AS (SELECT doc_id AS session, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS i, s FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS g FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\r\f\x0b')) AS p FROM documents)) WHERE s <> ''),
c AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9_]+'))), w)) / len(w) ELSE 0 END AS score FROM s, t),
k AS (SELECT *, row_number() OVER (PARTITION BY session, task_id ORDER BY score, i) - 1 AS k, count(*) OVER (PARTITION BY session, task_id) AS n FROM c),
h AS (SELECT *, max(score) FILTER (k = floor(n * 0.5)) OVER w AS high, max(score) FILTER (k = floor(n * 0.3)) OVER w AS mid FROM k WINDOW w AS (PARTITION BY session, task_id))
SELECT task_id, session, string_agg(CASE WHEN score >= high THEN s ELSE '[summary] ' || left(s, 120) END, chr(10) || chr(10) ORDER BY i) AS text FROM h WHERE score > 0 AND (score >= high OR score >= mid) GROUP BY 1, 2""")
def rk30(spark, sf):
    from engram.operators.compaction import compact

    c = table(spark, sf, "documents").select(F.col("doc_id").alias("session"), F.regexp_replace("text", "\n", "\n\n").alias("content"), F.col("lang").alias("project"))
    task = table(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("task"))  # a stated set of tasks
    return compact(c, task, 0.5)


@query("rk31_memory_context", MEM + "SELECT stem, round(0.15 * importance + 0.08 * 0.5 + 0.18 * 0.5, 6) AS composite FROM mem WHERE project = 'en' AND contains(lower(content), 'the') ORDER BY 2 DESC, stem LIMIT 10")
def rk31(spark, sf):
    from engram.operators.fusion import composite_score

    rows = mem(spark, sf).where("project = 'en' AND contains(lower(content), 'the')").select("stem", F.lit(1).alias("query_id"), F.lit(1.0).alias("score"), F.col("importance").alias("confidence"))
    return composite_score(rows).select("stem", F.round("composite", 6).alias("composite")).orderBy(F.desc("composite"), "stem").limit(10)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def decisions_sql() -> str:
    found = [(p, prose) for prose, patterns in ((False, ex.ANNOTATED), (True, ex.PROSE)) for p in patterns]
    each = " UNION ALL ".join(f"SELECT doc, {i} AS p, {prose} AS prose, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM (SELECT doc, list_transform(regexp_extract_all(content, {quoted(p)}, 1), lambda v: trim(v)) AS x FROM c)" for i, (p, prose) in enumerate(found))
    return f"""WITH c AS (SELECT conv_id || '/' || turn AS doc, CASE turn % 3 WHEN 0 THEN 'We decided to ' WHEN 1 THEN 'DECISION: ' ELSE '→ keep it' || chr(10) || 'Policy: ' END || text AS content FROM conversations), m AS ({each}),
    g AS (SELECT * FROM m WHERE t <> '' AND (NOT prose OR (length(t) >= 25 AND NOT regexp_matches(t, {quoted(ex.TOPICS)})))), d AS (SELECT doc, t, min(struct_pack(p := p, k := k)) AS spot FROM g GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY length(t) DESC, spot.p, spot.k) AS n FROM d), w AS (SELECT a.* FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc = a.doc AND b.n < a.n AND contains(lower(b.t), lower(a.t))))
    SELECT doc, t AS text, CAST(row_number() OVER (PARTITION BY doc ORDER BY n) AS INTEGER) AS i, 0.6::DOUBLE AS confidence FROM w QUALIFY i <= 50"""


def negatives_sql() -> str:
    each = " UNION ALL ".join(f"SELECT doc, {i} AS p, unnest(x) AS what, unnest(y) AS why, generate_subscripts(x, 1) AS k FROM (SELECT doc, list_transform(regexp_extract_all(content, {quoted(p)}, 1), lambda v: trim(v)) AS x, list_transform(regexp_extract_all(content, {quoted(p)}, 2), lambda v: trim(coalesce(v, ''))) AS y FROM c)" for i, p in enumerate(ex.NEGATIVE))
    return f"""WITH c AS (SELECT conv_id || '/' || turn AS doc, 'We tried ' || left(text, 30) || ' but it failed because ' || text AS content FROM conversations), m AS ({each}),
    f AS (SELECT * FROM m WHERE what <> '' QUALIFY row_number() OVER (PARTITION BY doc, lower(what) ORDER BY p, k) = 1)
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY p, k) AS INTEGER) AS i, what, why, 0.7::DOUBLE AS confidence FROM f QUALIFY i <= 30"""


@query("tx15_decisions", decisions_sql())
def tx15(spark, sf):
    m = F.col("turn") % 3
    lead = F.when(m == 0, "We decided to ").when(m == 1, "DECISION: ").otherwise("→ keep it\nPolicy: ")
    c = table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc"), F.concat(lead, F.col("text")).alias("content"))
    return ex.decisions(c, "doc", "content")


@query("tx16_negatives", negatives_sql())
def tx16(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc"), F.concat(F.lit("We tried "), F.substring("text", 1, 30), F.lit(" but it failed because "), F.col("text")).alias("content"))
    return ex.negatives(c, "doc", "content")
