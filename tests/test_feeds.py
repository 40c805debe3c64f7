"""Change feed, snapshot and stateful folds beyond what the queries' SQL shows: restarts, failures, expiry."""

import pytest
from pyspark.sql import functions as F

from engram.plans.streams import folder
from engram.sources import feed, snapshot
from engram.streaming import stateful

ROW = "tenant string, site string, drive string, page long, item string, op string, payload string"


def run_feed(spark, at, batches):
    q = feed.read_feed(spark, f"{at}/feed").writeStream.foreachBatch(lambda b, i: batches.append(sorted(map(tuple, b.collect())))).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()


def test_feed_reads_each_page_once(spark):
    at, batches = folder(spark), []
    page = lambda d, n: ("t", "s", d, n, f"i{n}", "add", "p")
    feed.write_pages(spark.createDataFrame([page("a", 0), page("a", 1), page("b", 5)], ROW), f"{at}/feed")
    run_feed(spark, at, batches)
    run_feed(spark, at, batches)  # nothing new
    feed.write_pages(spark.createDataFrame([page("a", 2), page("c", 0)], ROW), f"{at}/feed")
    run_feed(spark, at, batches)
    assert [b for b in batches if b] == [[page("a", 0), page("a", 1), page("b", 5)], [page("a", 2), page("c", 0)]]
    reader = feed.FeedReader(f"{at}/feed")
    assert reader.latestOffset() == {"tenant=t/site=s/drive=a": 2, "tenant=t/site=s/drive=b": 5, "tenant=t/site=s/drive=c": 0}
    assert len(reader.partitions({"tenant=t/site=s/drive=a": 1}, reader.latestOffset())) == 3  # one for each drive with new pages
    assert feed.FeedReader(f"{at}/none").latestOffset() == {}


def test_failed_feed_batch_is_read_again(spark):
    at, seen = folder(spark), []
    feed.write_pages(spark.createDataFrame([("t", "s", "a", 0, "i", "add", "p")], ROW), f"{at}/feed")

    def fail(batch, i):
        raise RuntimeError("no sink")

    with pytest.raises(Exception, match="no sink"):
        feed.read_feed(spark, f"{at}/feed").writeStream.foreachBatch(fail).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    run_feed(spark, at, seen)
    assert [b for b in seen if b] == [[("t", "s", "a", 0, "i", "add", "p")]]


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k long, v string, at int, op string")


def test_snapshot(spark, monkeypatch):
    at = folder(spark)
    snapshot.upsert(at, rows(spark, (1, "a", 0, "add"), (2, "b", 0, "add"), (None, "x", 0, "add"), (3, "c", 0, "delete")), ["k"], "at", op="op", buckets=4)
    table = lambda v=None: sorted(map(tuple, snapshot.read(spark, at, v).collect()))
    assert table() == [(1, "a", 0), (2, "b", 0)]
    change = rows(spark, (2, "late", 1, "add"), (2, "last", 2, "add"), (1, "z", 1, "delete"), (9, "n", 1, "add"), (5, None, 1, "add"))
    rejected = snapshot.upsert(at, change, ["k"], "at", op="op", valid=F.col("v").isNotNull())
    assert [tuple(r) for r in rejected.collect()] == [(5, None, 1, "add")]
    assert table() == [(2, "last", 2), (9, "n", 1)] and table(1) == [(1, "a", 0), (2, "b", 0)]
    snapshot.upsert(at, change, ["k"], "at", op="op", valid=F.col("v").isNotNull())
    assert table() == [(2, "last", 2), (9, "n", 1)] and snapshot.versions(spark, at) == [1, 2, 3]

    before, real = table(), snapshot.commit
    monkeypatch.setattr(snapshot, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        snapshot.upsert(at, rows(spark, (2, "never", 9, "add")), ["k"], "at", op="op")
    assert table() == before and snapshot.versions(spark, at) == [1, 2, 3]
    monkeypatch.setattr(snapshot, "commit", real)
    with pytest.raises(RuntimeError, match="another run"):
        snapshot.commit(spark, at, 3, {})
    with pytest.raises(ValueError, match="columns"):
        snapshot.upsert(at, spark.createDataFrame([(1, 2)], "k long, other int"), ["k"], "other")
    snapshot.upsert(at, rows(spark, (7, "only", 9, "add")), ["k"], "at", op="op")
    old, new = (snapshot.manifest(spark, at, v)["paths"] for v in (3, 4))
    assert sum(old.get(b) != p for b, p in new.items()) == 1  # one bucket was written anew


def test_state_expires(spark):
    """Late rows take their place; a key's state is gone once it has been silent for longer than it is kept."""
    at = folder(spark)
    schema = "user_id long, event_id long, ts timestamp, duration_ms double"

    def run(*values):
        spark.createDataFrame(list(values), "user_id long, event_id long, ts string, duration_ms double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{at}/in")
        with stateful.rocksdb(spark):
            out = stateful.think_times(spark.readStream.schema(schema).parquet(f"{at}/in"), "user_id", "duration_ms", keep_hours=2)
            out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return {r["event_id"]: r["think_ms"] for r in spark.read.parquet(f"{at}/out").collect()}, spark.read.format("statestore").option("stateVarName", "folded").load(f"{at}/log").count()

    run((1, 1, "2024-01-01 00:00:00", 1000.0), (1, 3, "2024-01-01 00:02:00", 0.0), (2, 9, "2024-01-01 00:00:30", None))
    found, _ = run((1, 2, "2024-01-01 00:01:00", 5000.0), (1, 4, "2024-01-01 01:30:00", 0.0))
    assert found == {1: None, 2: 59000.0, 3: 55000.0, 9: None}  # what the watermark (00:30) has passed, the late row in its place
    found, kept = run((3, 5, "2024-01-01 03:00:00", 0.0))
    assert {k: found[k] for k in (1, 2, 3, 4, 9)} == {1: None, 2: 59000.0, 3: 55000.0, 4: 5280000.0, 9: None} and kept >= 1
    _, kept = run((3, 6, "2024-01-01 12:00:00", 0.0))
    _, kept = run((3, 7, "2024-01-01 20:00:00", 0.0))
    assert kept <= 1  # sessions 1 and 2 are gone
