"""The same transforms over growing folders: shard producer, follow-along reader, log cursor; the state merge is in ``status``."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from threadloom.operators import samples, shards
from threadloom.operators.ordinal import with_ordinal
from threadloom.sources.store import forget, get_record, names_in, put_record, written
from threadloom.streaming.status import merge_status  # noqa: F401


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files that a producer adds to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _union(spark: SparkSession, paths: list[str], fallback: DataFrame) -> DataFrame:
    out = fallback
    for p in paths:
        out = out.unionByName(spark.read.schema(out.schema).parquet(p))
    return out


class ShardProducer:
    """Packs plain texts as they arrive into sized shards, each buffer sorted by length, as the batch job does.

    What isn't a whole buffer yet, and what isn't a whole shard yet, lies in a folder of the micro-batch that left it, with the
    counters; a repeated micro-batch starts again from the one before and replaces what it wrote, and a new process goes on
    where the last one stopped. Shards hold ids, labels and the other columns, not the text; rows are counted while they are packed. ``order`` names a column that orders texts inside a micro-batch. ``finish`` writes what is left.
    All records lie beside the shards on the file system of the session: ``producer_meta.json`` names the shards that are whole after each micro-batch,
    ``producer_done.json`` follows the last one, ``producer_error.json`` a failure, until a later micro-batch succeeds.
    """

    def __init__(self, out: str, window: int, shard_size: int = 5000, text: str = "text", order: str | None = None, progress: str | None = None):
        self.out, self.window, self.shard_size, self.text, self.order, self.progress = out.rstrip("/"), window, max(1, shard_size), text, order, progress
        self.buffer = shards.buffer_size(self.shard_size)

    def _state(self, spark: SparkSession, batch_id: int) -> dict:
        return get_record(spark, f"{self.out}/_state/{batch_id}.json") or {"seen": 0, "kept": 0, "flushed": 0, "shards": 0, "rest": None, "tail": None}

    def __call__(self, batch: DataFrame, batch_id: int, last: bool = False) -> None:
        try:
            self._take(batch, batch_id, last)
        except Exception as e:
            put_record(batch.sparkSession, f"{self.out}/producer_error.json", {"batch": batch_id, "error": f"{type(e).__name__}: {e}"[:4000]})
            raise

    def _take(self, batch: DataFrame, batch_id: int, last: bool) -> None:
        spark = batch.sparkSession
        before = self._state(spark, batch_id - 1)
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        seen, kept = Observation(), Observation()
        rows = batch.observe(seen, F.count(F.lit(1)).alias("n"))
        packed = samples.pack_plain(rows, self.window, self.text).drop(self.text, "labels").observe(kept, F.count(F.lit(1)).alias("n"))
        # ids are written once; only lengths are numbered and sorted
        fresh = written(packed.withColumns({"_b": F.lit(batch_id).cast("long"), "_u": F.monotonically_increasing_id()}), "batch")
        waiting = _union(spark, [before["rest"]] if before["rest"] else [], fresh)
        n = before["kept"] - before["flushed"] + kept.get["n"]
        flush = n if last else n // self.buffer * self.buffer
        done = before["flushed"] + flush
        whole = -(-done // self.shard_size) if last else done // self.shard_size
        keys = list(dict.fromkeys(["_b", self.order or "_b"]))
        lengths = waiting.select(*dict.fromkeys(["_b", "_u", *keys]), "seq_len")
        placed = with_ordinal(lengths, keys, "seq").withColumn("seq", F.col("seq") + before["flushed"])
        go, rest = placed.where(F.col("seq") < done), placed.where(F.col("seq") >= done).select("_b", "_u")
        ordered = shards.buffered_order(go, self.shard_size).select("_b", "_u", "global_idx", "shard_idx")
        ordered = waiting.join(ordered, ["_b", "_u"])
        folder = f"{self.out}/_state/{batch_id}"
        if before["tail"]:
            ordered = ordered.unionByName(spark.read.schema(ordered.schema).parquet(before["tail"]))
        out = ordered.where(F.col("shard_idx") < whole).drop("_b", "_u")
        shards.write_shards(out, f"{self.out}/shards", "overwrite", labels=True)
        waiting.join(rest, ["_b", "_u"], "left_semi").select(fresh.columns).write.mode("overwrite").parquet(f"{folder}/rest")
        ordered.where(F.col("shard_idx") >= whole).write.mode("overwrite").parquet(f"{folder}/tail")
        state = {"seen": before["seen"] + seen.get["n"], "kept": before["kept"] + kept.get["n"], "flushed": done, "shards": whole, "rest": f"{folder}/rest", "tail": f"{folder}/tail"}
        put_record(spark, f"{self.out}/_state/{batch_id}.json", state)
        put_record(spark, f"{self.out}/producer_meta.json", {"done": False, "num_shards": whole})
        if get_record(spark, f"{self.out}/producer_error.json"):
            put_record(spark, f"{self.out}/producer_error.json", None)  # an earlier try failed, this one didn't
        self._tell(spark, state, last)
        forget(fresh)

    def _tell(self, spark: SparkSession, state: dict, last: bool) -> None:
        if self.progress:
            put_record(spark, self.progress, {
                "seen_samples": state["seen"], "tokenized_samples": state["kept"], "skipped_samples": state["seen"] - state["kept"],
                "num_shards_written": state["shards"], "done": last, "updated_at": time.time()})

    def finish(self, spark: SparkSession, schema, config: dict | None = None) -> dict:
        """Writes the rest as last shards, the metadata and the mark that all is done; returns the metadata."""
        ids = [int(f[:-5]) for f in names_in(spark, f"{self.out}/_state") if f.endswith(".json")]
        end = max(ids, default=-1) + 1
        self(spark.createDataFrame([], schema), end, last=True)
        state = self._state(spark, end)
        meta = {
            **(config or {}), "done": True, "num_shards": state["shards"], "total_samples": state["kept"], "seen_samples": state["seen"], "skipped_samples": state["seen"] - state["kept"],
            "max_seq_length": self.window, "strict_whole_turns": True, "sort_by_length": True, "sort_buffer_size": self.buffer, "bucketed_shuffle": True}
        put_record(spark, f"{self.out}/producer_meta.json", meta)
        put_record(spark, f"{self.out}/producer_done.json", {"done": True})
        return meta


def produce_shards(stream: DataFrame, out: str, checkpoint: str, window: int, progress: str | None = None, text: str = "text", shard_size: int = 5000, order: str | None = None):
    """Starts a ``ShardProducer`` on a stream; it ends once all that is there has been read."""
    return stream.writeStream.foreachBatch(ShardProducer(out, window, shard_size, text, order, progress)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressListener(StreamingQueryListener):
    """Calls ``tell(stage, rows so far, rows of this step)`` for every micro-batch of the session's streams."""

    def __init__(self, tell):
        self.tell, self.total = tell, {}

    def onQueryStarted(self, event) -> None:
        self.total[event.id] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.total[p.id] = self.total.get(p.id, 0) + p.numInputRows
        self.tell(p.name or str(p.id), self.total[p.id], p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.total.pop(event.id, None)


def log_lines(stream: DataFrame, cursor: int, line_id: str = "line_id") -> DataFrame:
    """Lines after a cursor; the checkpoint of the query that writes them keeps the place afterwards."""
    return stream.where(F.col(line_id) > cursor)


def event_windows(stream: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and time window, with a watermark for late ones (harness breadth)."""
    got = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")
