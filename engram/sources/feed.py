"""A change feed (SRC18) as a Structured Streaming source: pages of added and deleted items, one cursor for each (tenant, site, drive).

A feed is a folder of pages, `tenant=T/site=S/drive=D/page=N`, each with Parquet files of (item, op, payload); a page never changes once it is
there. The stream's offset is a map from drive to the last page read, so the query's checkpoint is the store of cursors: a
run reads the pages after them, each once, and a restart goes on where the last committed batch ended. Every drive is a partition of
its own, its pages in order. Folders are listed and read through the file system that the path names, by the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "tenant string, site string, drive string, page long, item string, op string, payload string"
LEVELS = ("tenant", "site", "drive")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _children(at: fs.FileSystem, path: str, level: str) -> list[tuple[str, str]]:
    """(value, path) of the folders `level=value`."""
    found = at.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [(f.base_name.partition("=")[2], f.path) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{level}=")]


class Pages(InputPartition):
    """Pages (first, last] of one drive."""

    def __init__(self, drive: str, first: int, last: int) -> None:
        self.drive, self.first, self.last = drive, first, last


class FeedReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{tenant=T/site=S/drive=D: last page}; a drive without pages is absent."""
        at, root = _open(self.path)
        drives = [("", root)]
        for level in LEVELS:
            drives = [(f"{name}/{level}={value}".lstrip("/"), path) for name, p in drives for value, path in _children(at, p, level)]
        pages = {name: [int(v) for v, _ in _children(at, path, "page")] for name, path in drives}
        return {name: max(own) for name, own in sorted(pages.items()) if own}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(drive, start.get(drive, -1), last) for drive, last in end.items() if last > start.get(drive, -1)] or [Pages("", 0, -1)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if not partition.drive:
            return
        at, root = _open(self.path)
        where = dict(x.split("=", 1) for x in partition.drive.split("/"))
        for number, path in sorted((int(v), p) for v, p in _children(at, f"{root}/{partition.drive}", "page")):
            if partition.first < number <= partition.last:
                for f in sorted(f.path for f in at.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet")):
                    for batch in pq.ParquetFile(at.open_input_file(f)).iter_batches(columns=["item", "op", "payload"]):
                        same = [pa.array([where[level]] * batch.num_rows, pa.string()) for level in LEVELS]
                        yield pa.RecordBatch.from_arrays([*same, pa.array([number] * batch.num_rows, pa.int64()), *[batch[c].cast(pa.string()) for c in ("item", "op", "payload")]], names=[*LEVELS, "page", "item", "op", "payload"])

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the cursors and the feed keeps its pages."""


class ChangeFeed(DataSource):
    """spark.readStream.format("change_feed").option("path", folder)"""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> FeedReader:
        return FeedReader(self.options["path"])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed in a folder, as a stream."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").option("path", path).load()


def write_pages(rows: DataFrame, path: str) -> None:
    """Rows (tenant, site, drive, page, item, op, payload) as pages; a page's folder appears when its write commits."""
    rows.repartition(*LEVELS, "page").write.mode("append").partitionBy(*LEVELS, "page").parquet(path)
