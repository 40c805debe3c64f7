"""Model recommendation over observed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recommend(observed: DataFrame, excluded: list[str], budget: float | None = None) -> DataFrame:
    """Models of each category by quality per cost of a pass; a budget drops dearer ones, or marks the cheapest if none fits."""
    eligible = observed.where(~F.col("model_id").isin(excluded) & (F.col("confidence") != "low") & (F.col("quality_rate") > 0))
    scored = eligible.withColumn("score", F.try_divide("quality_rate", "cost_per_pass"))
    if budget is not None:
        w = Window.partitionBy("task_category")
        fits = F.col("avg_cost_usd") <= budget
        scored = scored.withColumn("_any", F.max(fits).over(w)).withColumn("_least", F.min("avg_cost_usd").over(w))
        scored = scored.where(fits | (~F.col("_any") & (F.col("avg_cost_usd") == F.col("_least")))).withColumn("over_budget", ~F.col("_any")).drop("_any", "_least")
    order = Window.partitionBy("task_category").orderBy(F.round("score", 9).desc(), F.round("avg_cost_usd", 9), "model_id")
    return scored.withColumn("rank", F.row_number().over(order))
