"""A stream that follows a producer: shards in between, done and error marks, restarts; records on the session's file system."""

import threading

import pytest

from threadloom.sources import store
from threadloom.streaming import follow, jobs

SCHEMA = "k long, text string"
COLUMNS = "shard_idx long, global_idx long, k long, input_ids array<int>"


def texts(spark, a, b):
    return spark.createDataFrame([(i, "w " * (i % 9 + 1)) for i in range(a, b)], SCHEMA)


def start(spark, out, tmp_path):
    stream = follow.follow_shards(spark, out, COLUMNS)
    return stream.writeStream.format("parquet").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()


def test_shards_that_appear_in_between(spark, tmp_path):
    out = str(tmp_path / "out")
    producer = jobs.ShardProducer(out, 24, 100, order="k")
    query = start(spark, out, tmp_path)  # before there is anything
    producer(texts(spark, 0, 700), 0)
    query.processAllAvailable()
    rows = lambda: sorted((r["shard_idx"], r["global_idx"], r["k"], len(r["input_ids"])) for r in spark.read.parquet(str(tmp_path / "sink")).collect())
    assert len(rows()) == 500  # whole shards of the one whole buffer
    query.stop()
    producer(texts(spark, 700, 1300), 1)
    query = start(spark, out, tmp_path)  # goes on behind the shards it had
    waiting = threading.Thread(target=follow.until_done, args=(query, spark, out, 0.1))
    waiting.start()
    producer.finish(spark, SCHEMA)
    waiting.join(60)
    assert not waiting.is_alive() and not query.isActive
    want = sorted((r["shard_idx"], r["global_idx"], r["k"], len(r["input_ids"])) for r in spark.read.parquet(f"{out}/shards").collect())
    assert rows() == want and len(want) == 1300


def test_error_of_the_producer(spark, tmp_path):
    out = str(tmp_path / "out")
    producer = jobs.ShardProducer(out, 24, 100, text="gone", order="k")
    with pytest.raises(Exception, match="gone"):
        producer(texts(spark, 0, 5), 0)
    with pytest.raises(follow.ProducerFailed, match="gone"):
        follow.until_done(start(spark, out, tmp_path), spark, out, 0.1)
    good = jobs.ShardProducer(out, 24, 100, order="k")
    good(texts(spark, 0, 5), 0)  # a later try takes the mark away
    assert store.get_record(spark, f"{out}/producer_error.json") is None
    good.finish(spark, SCHEMA)
    follow.until_done(start(spark, out, tmp_path), spark, out, 0.1)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 5


def test_done_without_shards(spark, tmp_path):
    out = str(tmp_path / "out")
    jobs.ShardProducer(out, 24, 100).finish(spark, SCHEMA)
    with pytest.raises(follow.ProducerFailed, match="no shard"):
        follow.until_done(start(spark, out, tmp_path), spark, out, 0.1)


def test_records(spark, tmp_path):
    path = f"{tmp_path}/a/b/r.json"
    assert store.get_record(spark, path) is None and store.names_in(spark, f"{tmp_path}/a") == []
    store.put_record(spark, path, {"x": "é"})
    store.put_record(spark, path, {"x": "ü", "y": None})
    assert store.get_record(spark, path) == {"x": "ü", "y": None}
    assert [n for n in store.names_in(spark, f"{tmp_path}/a/b") if not n.startswith(".")] == ["r.json"]
