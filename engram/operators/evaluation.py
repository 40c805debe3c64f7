"""Relevance evaluation and statistics (EV)."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """hits (query_id, id, rank), judged (query_id, id, gain > 0 if relevant): precision, hit, recall, MRR and nDCG at k for each judged query."""
    rel = judged.where("gain > 0")
    totals = rel.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "id"))).groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("_i") <= k, F.col("gain") / F.log2(F.col("_i") + 1))).alias("_ideal"))
    top = hits.where(F.col("rank") <= k).join(rel, ["query_id", "id"])
    got = top.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("_first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("_dcg"))
    found = F.coalesce("found", F.lit(0))
    return totals.join(got, "query_id", "left").select(
        "query_id", (found / k).alias("precision"), (found > 0).cast("int").alias("hit"), (found / F.col("relevant")).alias("recall"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("_dcg") / F.col("_ideal"), F.lit(0.0)).alias("ndcg"),
    )


def category_stats(scores: DataFrame) -> DataFrame:
    """scores (category, score): mean, sample deviation (one value: 0), number."""
    return scores.groupBy("category").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))


def composite(stats: DataFrame, scale: float = 100.0) -> DataFrame:
    """category_stats with the normalised score of each category (its mean over `scale`, within [0, 1]) and the composite, the unweighted mean of the categories' means."""
    total = stats.agg(F.avg("mean").alias("composite"))  # one row
    return stats.withColumn("normalised", F.least(F.greatest(F.col("mean") / scale, F.lit(0.0)), F.lit(1.0))).crossJoin(F.broadcast(total))


def match_rates(matches: DataFrame) -> DataFrame:
    """greedy_matches of all files as one row: tp, fp, fn, precision and recall (null where nothing was extracted or expected)."""
    s = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return s.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def miss_rates(best: DataFrame, extracted: DataFrame, clean: DataFrame, threshold: float = 0.5) -> DataFrame:
    """best (file, i, best) of expected negatives, extracted (file, ...) and clean (file: nothing should be found): targets, found, miss_rate (null without targets), clean_files and
    false_positives (extractions of clean files)."""
    t = best.agg(F.count("*").alias("targets"), F.count_if(F.round("best", 9) >= threshold).alias("found"))
    f = clean.select("file").distinct().agg(F.count("*").alias("clean_files"))
    e = extracted.join(clean.select("file").distinct(), "file", "left_semi").agg(F.count("*").alias("false_positives"))
    return t.withColumn("miss_rate", 1 - F.try_divide("found", F.col("targets"))).crossJoin(F.broadcast(f)).crossJoin(F.broadcast(e))


def bootstrap_mean(values: DataFrame, resamples: int = 5000, seed: int = 7) -> DataFrame:
    """values (grp, x): 95 % interval of the mean over resamples.

    Draw d of resample b takes the value whose place is a hash (md5) of seed, b and d modulo the group's size, so runs agree. A group is a stated
    set of scores; its values are one array that every resample indexes in its own row, and draws never become rows.
    """
    groups = values.groupBy("grp").agg(F.sort_array(F.collect_list("x")).alias("_x"), F.avg("x").alias("mean"), F.count("*").alias("n"))
    runs = groups.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).repartition(F.col("grp"), F.pmod("_b", F.lit(64)))

    def pick(d: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_b").cast("string"), d.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
        return F.get("_x", F.pmod(h, F.col("n")).cast("int"))

    drawn = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0.0), lambda a, d: a + pick(d)) / F.col("n")
    ends = runs.select("grp", drawn.alias("m")).groupBy("grp").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return groups.select("grp", "mean", "n").join(ends, "grp")


def delta_verdict(low: Column, high: Column, n: Column, least: int = 5) -> Column:
    return F.when(n < least, "insufficient").when(low > 0, "improved").when(high < 0, "regressed").otherwise("parity")


def signed_rank(pairs: DataFrame) -> DataFrame:
    """pairs (grp, a, b): Wilcoxon's signed ranks of a - b without zeros: n, w_plus, w_minus, w and the sum over ties of t^3 - t."""
    d = pairs.withColumn("_d", F.round(F.col("a") - F.col("b"), 9)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    tie = Window.partitionBy("grp", "_a")
    first = F.rank().over(Window.partitionBy("grp").orderBy("_a"))
    ranked = d.withColumn("_f", first).withColumn("_t", F.count("*").over(tie)).withColumn("_r", F.col("_f") + (F.col("_t") - 1) / 2)
    s = ranked.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    return s.withColumn("w", F.least("w_plus", "w_minus"))


def _p_value(n: int, w: float, ties: float) -> float:
    if n <= 25 and ties == 0:  # exact: subsets of 1..n by their sum
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    sd = sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return 1.0 if sd == 0 else min(1.0, erfc((abs(w - n * (n + 1) / 4) - 0.5) / sd / sqrt(2)))


def signed_rank_p(ranks: DataFrame) -> DataFrame:
    """signed_rank's rows with a two-sided p: exact up to 25 pairs without ties, else normal with tie and continuity correction."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(p=[_p_value(int(n), float(w), float(t)) for n, w, t in zip(p["n"], p["w"], p["ties"])])

    return ranks.mapInPandas(run, ranks.withColumn("p", F.lit(0.0)).schema)


def bow_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """a (file, i, text), b (file, j, text): bag-of-words cosine of all pairs of a file that share a word."""

    def bag(d: DataFrame, key: str) -> DataFrame:
        t = d.select("file", key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("w")).groupBy("file", key, "w").agg(F.count("*").alias("c"))
        return t.withColumn("_n", F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("file", key))))

    x, y = bag(a, "i").withColumnRenamed("_n", "_na").withColumnRenamed("c", "_ca"), bag(b, "j").withColumnRenamed("_n", "_nb").withColumnRenamed("c", "_cb")
    return x.join(y, ["file", "w"]).groupBy("file", "i", "j").agg((F.sum(F.col("_ca") * F.col("_cb")) / F.max("_na") / F.max("_nb")).alias("sim"))


def greedy_matches(expected: DataFrame, extracted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches of a file's expected (file, i, text) and extracted (file, j, text) items, best pairs first: tp, fp, fn for each file."""
    pairs = bow_cosine(expected, extracted).where(F.col("sim") >= threshold)

    def fold(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        used_i, used_j = set(), set()
        p = p.assign(s=p["sim"].round(9)).sort_values(["s", "i", "j"], ascending=[False, True, True])
        for i, j in zip(p["i"], p["j"]):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
        return pd.DataFrame({"file": [key[0]], "tp": [len(used_i)]})

    kind = expected.schema["file"].dataType.simpleString()
    tp = pairs.groupBy("file").applyInPandas(fold, f"file {kind}, tp long")
    n = expected.groupBy("file").agg(F.count("*").alias("want")).join(extracted.groupBy("file").agg(F.count("*").alias("got")), "file", "full_outer").join(tp, "file", "left").fillna(0, ["want", "got", "tp"])
    return n.select("file", "tp", (F.col("got") - F.col("tp")).alias("fp"), (F.col("want") - F.col("tp")).alias("fn"))


def best_similarity(targets: DataFrame, found: DataFrame) -> DataFrame:
    """(file, i, best): the greatest similarity of each target to anything found in its file, 0 if nothing shares a word."""
    best = bow_cosine(targets, found).groupBy("file", "i").agg(F.max("sim").alias("best"))
    return targets.select("file", "i").join(best, ["file", "i"], "left").fillna(0.0, ["best"])


def dedup_rates(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs (label, sim): share of true duplicates that are found and of others that are taken for duplicates."""
    hit = (F.col("sim") >= threshold).cast("double")
    return pairs.agg(F.avg(F.when(F.col("label") == "true-dup", hit)).alias("true_hit"), F.avg(F.when(F.col("label") == "false-dup", hit)).alias("false_dedup"))


def benchmark_regressions(baseline: DataFrame, results: DataFrame, threshold: float = 0.2) -> DataFrame:
    """baseline and results (metric, value): slower by more than the threshold fails, a missing result fails, a baseline of 0 or less is skipped."""
    both = baseline.select("metric", F.col("value").alias("base")).join(results.select("metric", F.col("value").alias("now")), "metric", "left")
    ratio = F.try_divide(F.col("now") - F.col("base"), F.col("base"))
    verdict = F.when(F.col("base").isNull() | (F.col("base") <= 0), "skipped").when(F.col("now").isNull(), "missing").when(ratio > threshold, "slower").otherwise("ok")
    return both.select("metric", verdict.alias("verdict"))


def win_rate(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    both = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id")
    return both.agg(F.avg((F.col("x") > F.col("y")).cast("double")).alias("win_rate"), F.count("*").alias("n"))


#: Weights of a Poisson variable of mean 1: a draw below the k-th of these, of 2**32, weighs k.
POISSON = [int(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(12)]
MASK = (1 << 64) - 1


def draws(keys: np.ndarray, seed: int, resamples: int) -> np.ndarray:
    """Weights (0 to 12) of each key in each resample: a function of the key, the seed and the resample's number alone."""
    z = (keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, resamples + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(np.array(POISSON, np.uint64), z >> np.uint64(32), side="right")


def bootstrap_sums(scores: DataFrame, seed: int = 7, resamples: int = 5000) -> DataFrame:
    """scores (grp, key, x), key a long that is unique in its group: mean, n and the 95 % interval (low, high) of the resampled means of each group.

    A score weighs Poisson(1) in each resample, drawn by counter from its key, so every task adds up its own rows' weights and
    weighted scores and the sums of all tasks are added by Spark: no group is gathered, and any partitioning gives the same draws. Null
    scores don't count; resamples of weight 0 have no mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            groups, keys, x = batch["grp"].to_pylist(), np.asarray(batch["key"]), np.asarray(batch["x"])
            where: dict = {}
            for i, g in enumerate(groups):
                where.setdefault(g, []).append(i)
            for g, own in where.items():
                weight, total = held.setdefault(g, (np.zeros(resamples, np.int64), np.zeros(resamples)))
                for a in range(0, len(own), 512):
                    w = draws(keys[own[a : a + 512]], seed, resamples)
                    weight += w.sum(axis=0)
                    total += x[own[a : a + 512]] @ w
        lists = [pa.array([h[i].tolist() for h in held.values()], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), batch_type), *lists], names=["grp", "w", "s"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = scores.where("x IS NOT NULL AND key IS NOT NULL").select("grp", F.col("key").cast("long").alias("key"), F.col("x").cast("double").alias("x"))
    batch_type, kind = to_arrow_type(rows.schema["grp"].dataType), rows.schema["grp"].dataType.simpleString()
    parts = rows.mapInArrow(run, f"grp {kind}, w array<long>, s array<double>").select("grp", F.posexplode(F.arrays_zip("w", "s")).alias("b", "z"))
    means = parts.groupBy("grp", "b").agg(F.sum("z.w").alias("w"), F.sum("z.s").alias("s")).where("w > 0").withColumn("m", F.col("s") / F.col("w"))
    ends = means.groupBy("grp").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    ends = ends.withColumnRenamed("grp", "_g")
    return rows.groupBy("grp").agg(F.avg("x").alias("mean"), F.count("*").alias("n")).join(ends, F.col("grp").eqNullSafe(F.col("_g"))).select("grp", "mean", "n", "low", "high")
