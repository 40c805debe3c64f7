"""Sinks (SNK): metric lines by day, roll-ups that replace, gated exports, discovery documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_lines(rows: DataFrame, path: str, ts: str = "timestamp") -> None:
    """JSON lines in one folder for each day."""
    rows.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def replace_rollups(old: DataFrame, new: DataFrame, keys: list[str], computed: str) -> DataFrame:
    """Old and new roll-ups as one snapshot: the latest computed of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(computed))
    return old.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_rollups(rows: DataFrame, path: str, day: str) -> None:
    """Days that rows hold replace those of the table; other days stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def export(rows: DataFrame, decisions: DataFrame, key: str, path: str, fmt: str) -> DataFrame:
    """Write the rows that decisions (key, allowed, reason) allow; the audit rows are returned."""
    allowed = rows.join(decisions.where("allowed").select(key), key, "left_semi")
    writer = allowed.write.mode("errorifexists")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[fmt](path)
    return decisions.select(key, F.when(F.col("allowed"), "export_allowed").otherwise("export_denied").alias("event_type"), "reason")


def discovery_documents(entries: DataFrame, order: str) -> DataFrame:
    """entries (project, entry, confidence): a bullet list for each project in the given order, importance = greatest confidence."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "entry"))), lambda x: F.concat(F.lit("- "), x["entry"]))
    return entries.groupBy("project").agg(F.concat(F.lit("# "), F.first("project"), F.lit("\n"), F.array_join(lines, "\n")).alias("body"), F.max("confidence").alias("importance"))


def with_front_matter(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """discovery_documents with a front matter block: project, importance (the greatest confidence of its entries, one digit) and number of entries."""
    n = entries.groupBy("project").agg(F.count("*").alias("_n"))
    head = F.format_string("---\nproject: %s\nimportance: %.1f\nentries: %d\n---\n\n", "project", "importance", "_n")
    return documents.join(n, "project").withColumn("body", F.concat(head, "body")).drop("_n")


def write_discoveries(documents: DataFrame, existing: DataFrame | None, path: str) -> None:
    """One text file folder for each project and date; the first document of a project and date wins."""
    new = documents if existing is None else documents.join(existing.select("project", "date"), ["project", "date"], "left_anti")
    new.select("project", "date", F.col("body").alias("value")).write.mode("append").partitionBy("project", "date").text(path)
