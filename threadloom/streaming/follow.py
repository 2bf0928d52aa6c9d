"""Shards as a stream while their producer is at work: in order, to the done mark, or to the producer's error."""

from __future__ import annotations

import json
import time

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from threadloom.sources.store import get_record


class ProducerFailed(RuntimeError):
    """The producer left its error, or its done mark without any shard."""


def _open(path: str):
    """File system and path of a URI or of a plain local name."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _record(path: str) -> dict | None:
    files, name = _open(path)
    if files.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(name) as f:
        return json.loads(f.read())


class Shard(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class ShardReader(DataSourceStreamReader):
    """Offsets count whole shards, so a restart goes on behind the last shard that a micro-batch took; each shard is one task.

    Only shards that the producer's record names as whole are seen, however many files lie there.
    """

    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"shard": 0}

    def latestOffset(self) -> dict:
        error = _record(f"{self.path}/producer_error.json")
        if error:
            raise ProducerFailed(error["error"])
        return {"shard": int((_record(f"{self.path}/producer_meta.json") or {}).get("num_shards", 0))}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(i) for i in range(start["shard"], end["shard"])]

    def read(self, partition: Shard):
        files, name = _open(f"{self.path}/shards/shard_idx={partition.number}")
        out = to_arrow_schema(self.schema)
        own = [n for n in out.names if n != "shard_idx"]
        for batch in ds.dataset(name, filesystem=files, format="parquet").to_batches(columns=own, batch_size=4096):
            number = pa.array([partition.number] * batch.num_rows)
            columns = [number if f.name == "shard_idx" else batch.column(f.name) for f in out]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], out.names)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a micro-batch."""


class ShardSource(DataSource):
    """Format ``producer_shards``: option ``path`` is the producer's folder; the schema is the caller's, any columns of the shards."""

    @classmethod
    def name(cls) -> str:
        return "producer_shards"

    def streamReader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"].rstrip("/"), schema)


def follow_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of a producer's shards in their order, samples with ``shard_idx`` if the schema names it. Its folder must be readable from the executors."""
    spark.dataSource.register(ShardSource)
    return spark.readStream.format("producer_shards").schema(schema).option("path", path).load()


def until_done(query: StreamingQuery, spark: SparkSession, path: str, poll: float = 0.5) -> None:
    """Waits until the producer is done and the query has taken every shard, then ends the query.

    The producer's error ends it too and is raised; so is an end without any shard, as nothing could be trained on it.
    """
    try:
        while query.isActive:
            if get_record(spark, f"{path}/producer_done.json"):
                if not get_record(spark, f"{path}/producer_meta.json")["num_shards"]:
                    raise ProducerFailed("the producer is done and wrote no shard")
                query.processAllAvailable()  # the record of shards is final now
                return
            time.sleep(poll)
        if query.exception():
            raise query.exception()
    except PySparkException as e:
        error = get_record(spark, f"{path}/producer_error.json")
        if error:
            raise ProducerFailed(error["error"]) from e
        raise
    finally:
        query.stop()
