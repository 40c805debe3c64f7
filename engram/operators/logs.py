"""Counts and side tables of what filters drop, taken while the rows are written: gates (RK21-RK23), ACL leaks (FL6), mined prompts (SRC16).

Counts are DataFrame.observe metrics, so they cost no scan of their own; they are there when the write has ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.functions.names import fresh
from engram.operators import filters as fl
from engram.operators.fusion import fail_open


def gated(pool: DataFrame, gates: dict[str, Column], path: str) -> tuple[DataFrame, dict[str, int]]:
    """pool (query_id, id, ...) behind gates passed one after the other, a query's whole pool where none of its rows passes all (`fallback`): the rows, written to
    path, and how many entered, passed each gate (and all before it) and were let through by falling back. A gate that is null is not passed."""
    survivors, passed = {}, F.lit(True)
    for name, gate in gates.items():
        passed = passed & F.coalesce(gate, F.lit(False))
        survivors[name] = passed
    flags = {fresh(f"_{name}", pool.columns): p for name, p in survivors.items()}
    entered, left = Observation(), Observation()
    seen = pool.withColumns(flags).observe(entered, F.count(F.lit(1)).alias("entered"), *[F.count_if(F.col(flag)).alias(name) for flag, name in zip(flags, gates)])
    kept = fail_open(seen, F.col(list(flags)[-1])).drop(*flags).observe(left, F.count(F.lit(1)).alias("returned"), F.count_if(F.col("fallback")).alias("fallback"))
    kept.write.parquet(path)
    return pool.sparkSession.read.parquet(path), {**entered.get, **left.get}


def verified(rows: DataFrame, acl: str, ids: list[str], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Ranked rows that a principal may see (a missing ACL is open), those that would have leaked, and the counts checked, open (without an ACL) and leaked; one pass
    writes both tables under path."""
    shown = F.coalesce(fl.acl_open(F.col(acl), ids), F.lit(False))
    leaked = fresh("leaked", rows.columns)
    seen = Observation()
    marked = rows.withColumn(leaked, ~shown).observe(seen, F.count(F.lit(1)).alias("checked"), F.count_if(F.col(acl).isNull()).alias("open"), F.count_if(F.col(leaked)).alias("leaked"))
    marked.write.partitionBy(leaked).parquet(path)
    both = rows.sparkSession.read.schema(marked.schema).parquet(path)
    return both.where(~F.col(leaked)).drop(leaked), both.where(leaked).drop(leaked), seen.get


def mined(messages: DataFrame, least: int, path: str) -> tuple[DataFrame, dict[str, int]]:
    """mine_prompts with counts: messages, other roles, too short, tool wrappers (each without those before), candidates, kept and duplicates."""
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    long = F.coalesce(F.length("text") >= least, F.lit(False))
    tool = F.coalesce(tx.is_wrapper(F.col("text")), F.lit(False))
    first, last = Observation(), Observation()
    why = F.when(~user, "other_role").when(~long, "too_short").when(tool, "wrapper").otherwise("candidates")
    w, h, r = (fresh(x, messages.columns) for x in ("why", "hash", "place"))
    seen = messages.withColumn(w, why).observe(first, F.count(F.lit(1)).alias("messages"), *[F.count_if(F.col(w) == x).alias(x) for x in ("other_role", "too_short", "wrapper", "candidates")])
    kept = seen.where(F.col(w) == "candidates").withColumn(h, tx.normalised_hash(F.col("text"))).withColumn(r, F.row_number().over(Window.partitionBy(h).orderBy("conv_id", "turn"))).where(F.col(r) == 1).drop(w, h, r)
    kept.withColumn("text", tx.redact(F.col("text"))).observe(last, F.count(F.lit(1)).alias("kept")).write.parquet(path)
    counts = {**first.get, **last.get}
    return messages.sparkSession.read.parquet(path), counts | {"duplicates": counts["candidates"] - counts["kept"]}
