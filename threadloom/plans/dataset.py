"""The whole dataset build: rows to packed, sorted, sharded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import samples, shards, threads
from threadloom.operators.ordinal import with_ordinal
from threadloom.sources import tables


def build_samples(rows: DataFrame, mode: str = "chat", column: str = "text", window: int = 1024, max_history: int | None = None, prompt_loss: bool = False) -> DataFrame:
    """Packed samples in source order with ``seq``; threads if the columns allow it, else the plain column. Needs ``_rowidx``."""
    if tables.is_threaded(rows, mode):
        order = ["thread_first", "depth", "_rowidx"]
        got = samples.pack_chat(samples.chat_sample(threads.chains(rows)), window, max_history, prompt_loss).where("skipped is null")
        kept = with_ordinal(got, order)
    else:
        got = samples.pack_plain(rows.select("_rowidx", F.col(column).alias("text")), window)
        kept = with_ordinal(got, ["_rowidx"])
    return kept.select("seq", "input_ids", "labels", "seq_len")


def build_shards(rows: DataFrame, path: str, shard_size: int = 5000, by_length: bool = True, by_similarity: bool = False, **kw) -> DataFrame:
    """Writes the shards of ``build_samples`` below ``path``; returns their manifest."""
    ordered = shards.buffered_order(build_samples(rows, **kw), max(100, shard_size), by_length, by_similarity)
    shards.write_shards(ordered, path)
    return shards.manifest(rows.sparkSession.read.parquet(path), max(100, shard_size))
