"""Ranks over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def global_rank(df: DataFrame, order: str, key: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """df with its 0-based rank by a numeric column and then key.

    At most BUCKETS quantiles deal the rows; ranks are a bucket's start (a table of as many rows, broadcast) plus the
    place in the bucket. Any quantiles give the same ranks.
    """
    cuts = sorted(set(df.select(F.percentile_approx(order, [i / BUCKETS for i in range(1, BUCKETS)]).alias("c")).first()["c"] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("_b", -bucket if descending else bucket)
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(by, key)) - 1)
    return ranked.join(F.broadcast(starts), "_b").withColumn(name, F.col("_s") + F.col("_r")).drop("_b", "_n", "_s", "_r")
