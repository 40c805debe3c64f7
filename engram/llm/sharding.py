"""Reproducible sharding by a Feistel permutation of global row numbers.

Every row gets a number from 0 to N-1 that depends on the rows alone, a keyed Feistel network
permutes the numbers (cycle walking keeps them below N), and the permuted number p says where the
row goes: shard p mod S, slot p div S. Shards differ by one row at most, slots have no gap, and
anyone who knows N and the seed can compute where row number r is.

Defined results: a null text has no bytes; a null doc_id sorts first; rows equal in id, checksum
and size are interchangeable; an empty table gives an empty result; columns of the input that
clash with shard and slot are replaced.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import fresh, group_count, table

ROUNDS = 6
#: Rows that are sorted together; the starts of N / BUCKET_ROWS buckets are broadcast.
BUCKET_ROWS = 1 << 19
#: Applications of the network that are always enough: each one leaves the range with a chance below 2 / sqrt(N),
#: and never more often in a row than there are values outside it.
WALK = 64


def _apply(p: Column, side: int, seed: int) -> Column:
    """One pass of the network over [0, side * side): (l, r) -> (r, l + f(r) mod side), ROUNDS times."""
    start = F.struct(F.floor(p / F.lit(side)).cast("long").alias("l"), F.pmod(p, F.lit(side)).cast("long").alias("r"))
    keys = F.array(*[F.lit(seed * 1_000_003 + i).cast("long") for i in range(ROUNDS)])
    end = F.aggregate(keys, start, lambda a, k: F.struct(a["r"].alias("l"), F.pmod(a["l"] + F.pmod(F.xxhash64(k, a["r"]), F.lit(side)), F.lit(side)).cast("long").alias("r")))
    return end["l"] * F.lit(side) + end["r"]


def feistel(number: Column, total: int, seed: int) -> Column:
    """A keyed permutation of [0, total), applied to a long column."""
    if total <= 1:
        return number
    side = isqrt(total - 1) + 1
    steps = F.sequence(F.lit(1), F.lit(min(WALK, side * side - total + 1)))
    walked = F.aggregate(steps, F.struct(F.lit(False).alias("done"), number.cast("long").alias("p")), lambda a, _: F.when(a["done"], a).otherwise(_step(a["p"], side, total, seed)))
    return F.when(walked["done"], walked["p"]).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def _step(p: Column, side: int, total: int, seed: int) -> Column:
    q = F.transform(F.array(p), lambda x: _apply(x, side, seed))[0]
    return F.transform(F.array(q), lambda x: F.struct((x < F.lit(total)).alias("done"), x.alias("p")))[0]


def row_numbers(df: DataFrame, buckets: int, keys: tuple[str, ...], name: str) -> DataFrame:
    """df with the column `name`: 0 to N-1, by hash bucket and then by keys; one narrow shuffle and no single-task sort.

    The bucket sizes (at most `buckets` rows) are the only thing that is broadcast.
    """
    bucket, n, start, rank = (fresh(x, [*df.columns, name]) for x in ("bucket", "n", "start", "rank"))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(bucket).agg(F.count("*").alias(n))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(bucket).orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    numbered = df.withColumn(rank, F.row_number().over(within) - 1).join(F.broadcast(starts), bucket)
    return numbered.withColumn(name, F.col(start) + F.col(rank)).drop(bucket, start, rank)


def assign_shards(df: DataFrame, shards: int, seed: int = 7, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df with `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard)."""
    total = df.count()
    rest = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    number, p = fresh("number", df.columns), fresh("p", df.columns)
    placed = row_numbers(df.select(*rest), group_count(total, BUCKET_ROWS, 64), keys, number).withColumn(p, feistel(F.col(number), total, seed))
    return placed.select(*rest, F.pmod(p, F.lit(shards)).cast("int").alias("shard"), F.floor(F.col(p) / F.lit(shards)).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    shards = sharded.select("shard").distinct().count()
    sharded.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(docs, 40, keys=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
