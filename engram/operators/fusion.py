"""Rank fusion, blends and gates (RK15-RK27) over candidate pools: rows of (query_id, id, score, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the eight signals of the composite score. Fixed values.
SIGNALS = {"semantic": 0.25, "lexical": 0.18, "confidence": 0.15, "regime_match": 0.12, "graph_proximity": 0.10, "recency": 0.08, "historical_usefulness": 0.07, "workflow_intent": 0.05}
SIGNAL_DEFAULTS = {"confidence": 0.7, "recency": 0.5}


def ranked(pool: DataFrame, score: str = "score", by: str = "query_id", key: str = "id", name: str = "rank") -> DataFrame:
    """pool with its rank by score (to nine places) and then id."""
    return pool.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key)))


def top_k(pool: DataFrame, k: int, score: str = "score", by: str = "query_id", key: str = "id") -> DataFrame:
    return ranked(pool, score, by, key).where(F.col("rank") <= k)


def pool_percentile(pool: DataFrame, by: list[str], score: str, name: str = "percentile") -> DataFrame:
    """The share of the pool's others that score less; alone: 1 if positive."""
    w = Window.partitionBy(*by)
    alone = F.when(F.col(score) > 0, 1.0).otherwise(0.0)
    return pool.withColumn(name, F.when(F.count("*").over(w) == 1, alone).otherwise(F.percent_rank().over(w.orderBy(score))))


def minmax(value: str | Column, by: list[str], flat: float = 0.0) -> Column:
    """Min-max over the group; `flat` where all values are equal."""
    w = Window.partitionBy(*by)
    v = F.col(value) if isinstance(value, str) else value
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high > low, (v - low) / (high - low)).otherwise(F.when(v.isNotNull(), F.lit(flat)))


def softmax(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return e / F.sum(e).over(w)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """lists of (query_id, id, rank); the sum of 1 / (k + rank)."""
    union = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return union.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def linear_blend(lexical: DataFrame, vector: DataFrame, a: float = 0.4, b: float = 0.6) -> DataFrame:
    """a * min-max of the lexical score (flat: 0) + b * max(0, cosine)."""
    l = lexical.withColumn("_l", minmax("score", ["query_id"])).select("query_id", "id", "_l")  # noqa: E741
    v = vector.select("query_id", "id", F.greatest("score", F.lit(0.0)).alias("_v"))
    both = l.join(v, ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", (a * F.coalesce("_l", F.lit(0.0)) + b * F.coalesce("_v", F.lit(0.0))).alias("score"))


def layer_blend(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """0.6 * raw lexical + 0.4 * vector; vector hits that no lexical hit has are appended."""
    both = lexical.select("query_id", "id", F.col("score").alias("_l")).join(vector.select("query_id", "id", F.col("score").alias("_v")), ["query_id", "id"], "full_outer")
    layer = F.when(F.col("_l").isNull(), "vector").when(F.col("_v").isNull(), "lexical").otherwise("fused")
    return both.select("query_id", "id", F.round(0.6 * F.coalesce("_l", F.lit(0.0)) + 0.4 * F.coalesce("_v", F.lit(0.0)), 6).alias("score"), layer.alias("layer"))


def weighted_fusion(pool: DataFrame) -> DataFrame:
    """score * n * softmax(cosine) * source weight; without a cosine, score * source weight."""
    w = Window.partitionBy("query_id")
    n = F.count("cosine").over(w)
    fused = F.when(F.col("cosine").isNull(), F.col("score") * F.col("source_weight")).otherwise(F.col("score") * n * softmax("cosine", ["query_id"]) * F.col("source_weight"))
    return pool.withColumn("fused", fused)


def parallel_gates(pool: DataFrame, alpha: float = 0.7, b: float = 0.3, c: float = 0.3, delta: float = 0.4) -> DataFrame:
    """pool: query_id, id, cosine, nearest (best similarity to another candidate), score. Keeps rows that pass all three gates,
    or the whole pool of a query where none does (`fallback`)."""
    p = pool_percentile(pool, ["query_id"], "score")
    mixed = alpha * F.col("cosine") + (1 - alpha) * F.col("percentile")
    judged = p.withColumn("delta", mixed).withColumn("_ok", (F.col("cosine") >= b) & (F.col("nearest") >= c) & (mixed >= delta))
    w = Window.partitionBy("query_id")
    return judged.withColumn("fallback", ~F.max("_ok").over(w)).where(F.col("_ok") | F.col("fallback")).drop("_ok")


def sequential_gates(pool: DataFrame, soft: float = 0.3, c: float = 1 / 3, delta: float = 0.1) -> DataFrame:
    """pool in `rank` order with `cosine` and `embedding`: a weak query match is damped to a tenth; continuity with the last
    embedded row before it (1 for the first); the product must reach delta."""
    from engram.functions.vectors import cosine

    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("embedding", ignorenulls=True).over(w)
    seen = pool.withColumn("_last", last)
    link = F.when(F.col("_last").isNull() | F.col("embedding").isNull(), 1.0).when(cosine(F.col("embedding"), F.col("_last")) >= c, 1.0).otherwise(F.lit(1 / 3))
    gate = F.when(F.col("cosine") >= soft, F.col("cosine")).otherwise(F.col("cosine") * 0.1)
    return seen.withColumn("product", gate * link).where(F.col("product") >= delta).drop("_last")


def composite_score(pool: DataFrame) -> DataFrame:
    """The eight weighted signals, clamped to [0, 1]; missing columns take their defaults; lexical is min-max (flat: 0.5)."""
    have = set(pool.columns)
    lexical = minmax("score", ["query_id"], flat=0.5)
    value = {s: F.coalesce(F.col(s), F.lit(SIGNAL_DEFAULTS.get(s, 0.0))) if s in have else F.lit(SIGNAL_DEFAULTS.get(s, 0.0)) for s in SIGNALS} | {"lexical": lexical}
    parts = {s: value[s] * w for s, w in SIGNALS.items()}
    total = reduce(lambda a, b: a + b, parts.values())
    return pool.withColumn("breakdown", F.struct(*[c.alias(s) for s, c in parts.items()])).withColumn("composite", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def rerank(pool: DataFrame, external: DataFrame, k: int) -> DataFrame:
    """pool (query_id, id, rank) reordered by external (query_id, id, ext; or id, ext where a score holds for all queries): scored rows first, then the rest in their order, to k."""
    both = pool.join(external, [c for c in ("query_id", "id") if c in external.columns], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("ext").isNull(), F.desc_nulls_last("ext"), "rank")
    return both.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def materialise(items: DataFrame, capacity: int, score: float = 0.1, novelty: float = 0.2) -> DataFrame:
    """items: id, score, nearest (best cosine to the existing store, null if none), known (id is in the store).
    Outcome of each: below_score, not_novel, evicted (beyond capacity, lowest first) or stored."""
    new = F.coalesce(1 - F.col("nearest"), F.when(F.col("known"), 0.0).otherwise(1.0))
    first = items.withColumn("outcome", F.when(F.col("score") < score, "below_score").when(new < novelty, "not_novel"))

    order = Window.partitionBy("store", F.col("outcome").isNull()).orderBy(F.round("score", 9).desc(), "id")
    place = F.row_number().over(order)
    return first.withColumn("outcome", F.coalesce("outcome", F.when(place <= capacity, "stored").otherwise("evicted")))


def materialise_into(items: DataFrame, store: DataFrame, capacity: int, score: float = 0.1, novelty: float = 0.2) -> DataFrame:
    """items (store, id, score, nearest, known) and what is in the stores (store, id, score): the outcome of each item and each old row. Items are refused by score or novelty; what
    is left competes with the old rows of its store, and the lowest beyond `capacity` are evicted (on equal scores the larger id, a new row before an old one)."""
    new = F.coalesce(1 - F.col("nearest"), F.when(F.col("known"), 0.0).otherwise(1.0))
    judged = items.select("store", "id", "score", F.lit(True).alias("is_new"), F.when(F.col("score") < score, "below_score").when(new < novelty, "not_novel").alias("outcome"))
    every = judged.unionByName(store.select("store", "id", "score", F.lit(False).alias("is_new"), F.lit(None).cast("string").alias("outcome")))
    place = F.row_number().over(Window.partitionBy("store", F.col("outcome").isNull()).orderBy(F.round("score", 9).desc(), "is_new", "id"))
    return every.withColumn("outcome", F.coalesce("outcome", F.when(place > capacity, "evicted").when(F.col("is_new"), "stored").otherwise("kept")))


def fail_open(pool: DataFrame, passes: Column) -> DataFrame:
    """Rows that pass, or a query's whole pool if none does; `fallback` says which."""
    kept = F.count_if(passes).over(Window.partitionBy("query_id"))
    return pool.withColumn("_kept", kept).where((F.col("_kept") == 0) | passes).withColumn("fallback", F.col("_kept") == 0).drop("_kept")
