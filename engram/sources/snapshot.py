"""A table of the latest row of each key (SNK3) in hash buckets, replaced bucket by bucket under a manifest.

`root/manifests/N.json` names the data folder of every bucket at version N; the highest N is the table. An upsert reads the buckets that its
changes touch, writes those anew into a folder of its own and commits by renaming a finished manifest to the next number. A run
that fails before the rename leaves the table as it was; of two writers of one number the second fails and can be run again.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    fs, p = _fs(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    fs, p = _fs(spark, f"{root}/manifests/{version:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """The manifest under its number, by one rename."""
    fs, draft = _fs(spark, f"{root}/manifests/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, final = _fs(spark, f"{root}/manifests/{version:012d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of {root} has been written by another run")


def read(spark: SparkSession, root: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table at a version (the last one, if None); of some buckets only, if asked."""
    last = version or versions(spark, root)[-1]
    m = manifest(spark, root, last)
    paths = sorted({path for b, path in m["paths"].items() if buckets is None or int(b) in buckets})
    schema = T.StructType.fromJson(m["schema"])
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def upsert(root: str, changes: DataFrame, keys: list[str], order: str, op: str | None = None, kept: tuple[str, ...] = (), valid: Column | None = None, buckets: int = 64) -> DataFrame:
    """Bring the table up to date with changes and return the changes that were rejected (valid isn't true, or a key is null).

    The change of greatest `order` counts for each key; op: a column in which 'delete' removes the key. Columns `kept` stay as an
    existing row has them. buckets: of a new table; an existing one keeps its own number. Applying the same changes again
    changes nothing.
    """
    spark = changes.sparkSession
    good = F.coalesce(F.lit(True) if valid is None else valid, F.lit(False))
    for k in keys:
        good = good & F.col(k).isNotNull()
    known = versions(spark, root)
    held = manifest(spark, root, known[-1]) if known else {"buckets": buckets, "paths": {}}
    values = [c for c in changes.columns if c not in (*keys, op)]
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(held["buckets"])).cast("int")
    row = F.struct(*values, *([op] if op else []))
    latest = changes.where(good).groupBy(*keys).agg(F.max_by(row, F.struct(F.col(order), F.xxhash64(row))).alias("_new")).withColumn("_bucket", bucket)
    folder = f"data/{uuid.uuid4().hex}"
    fresh = latest.withColumn("_gone", F.coalesce(F.col(f"_new.{op}") == "delete", F.lit(False)) if op else F.lit(False))
    fresh.write.parquet(f"{root}/{folder}/changes")
    fresh = spark.read.parquet(f"{root}/{folder}/changes")
    touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]  # one number a bucket
    schema = changes.select(*keys, *values).schema
    if known:
        if T.StructType.fromJson(held["schema"]).fieldNames() != schema.fieldNames():
            raise ValueError(f"the table has the columns {T.StructType.fromJson(held['schema']).fieldNames()}")
        old = read(spark, root, known[-1], touched)
    else:
        old = spark.createDataFrame([], schema)
    both = fresh.join(old.select(*keys, F.struct(*values).alias("_old")), keys, "full_outer")
    new = lambda c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c in kept)), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
    merged = both.where("NOT coalesce(_gone, false)").select(*keys, *[new(c).alias(c) for c in values], bucket.alias("_bucket"))
    merged.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}/rows")
    fs, p = _fs(spark, f"{root}/{folder}/rows")
    written = {int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith("_bucket=")}
    paths = {b: path for b, path in held["paths"].items() if int(b) not in touched} | {str(b): f"{folder}/rows/_bucket={b}" for b in sorted(written)}
    commit(spark, root, (known[-1] if known else 0) + 1, {"buckets": held["buckets"], "schema": schema.jsonValue(), "paths": paths})
    return changes.where(~good)
