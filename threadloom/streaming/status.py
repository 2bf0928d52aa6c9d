"""Last known status of runs as a stream: typed state by key, a table as its start, timers that drop ended runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _reduced(rows: pa.Table, n: int) -> pa.Table:
    """A row a key: its last event and, for each field, the last known value with its time; of equal times the greater value."""
    out = rows.group_by("key", use_threads=False).aggregate([("at", "max")]).select(["key", "at_max"]).rename_columns(["key", "at"])
    for i in range(n):
        v = f"v{i}"
        known = rows.select(["key", f"at{i}", v]).filter(pc.field(v).is_valid()).sort_by([(f"at{i}", "ascending"), (v, "ascending")])
        places = known.select(["key"]).append_column("p", pa.array(range(known.num_rows), pa.int64()))
        last = known.take(places.group_by("key", use_threads=False).aggregate([("p", "max")]).column("p_max"))
        out = out.join(last, keys="key", join_type="left outer", use_threads=False)
    return out


def _combine(n: int, schema: StructType, at_once: int = 100_000):
    """Arrow function that leaves a row a key of each ``at_once`` rows, so that a key with many events is no long group behind the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, held, size = to_arrow_schema(schema), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                yield from _reduced(pa.Table.from_batches(held), n).select(want.names).cast(want).to_batches()
                held, size = [], 0
        if size:
            yield from _reduced(pa.Table.from_batches(held), n).select(want.names).cast(want).to_batches()

    return run


class StatusState(StatefulProcessor):
    """Holds ``at, at0, v0, at1, v1, ...`` of a run: its last event, and each field's last known value with its time, in the types of the stream."""

    def __init__(self, held: StructType, names: list[str], ended: int | None = None, keep_ms: int | None = None):
        self.held, self.names, self.ended, self.keep_ms = held, names, ended, keep_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("status", self.held)

    def _taken(self, rows, timers) -> list:
        held = list(self.state.get()) if self.state.exists() else [None] * len(self.held)
        for r in rows:
            r = tuple(r)[1:]
            held[0] = r[0] if held[0] is None else max(held[0], r[0])
            for i in range(1, len(r), 2):
                if r[i + 1] is not None and (held[i + 1] is None or self._rank(r[i], r[i + 1]) > self._rank(held[i], held[i + 1])):
                    held[i : i + 2] = r[i : i + 2]
        self.state.update(tuple(held))
        if self.ended is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held[2 + 2 * self.ended]:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.keep_ms)
        return held

    @staticmethod
    def _rank(at, value) -> tuple:
        return at, value != value, value  # NaN above all numbers, as the tasks before sort it

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._taken(rows, timerValues)
        yield Row(**dict(zip(self.names, (key[0], held[0], *held[2::2]), strict=True)))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._taken([initialState], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()


def _events(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    cols = [F.col(key).alias("key"), F.col(order).alias("at")]
    for i, f in enumerate(fields):
        cols += [F.when(F.col(f).isNotNull(), F.col(order)).alias(f"at{i}"), F.col(f).alias(f"v{i}")]
    return df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(*cols)


def merge_status(stream: DataFrame, key: str, order: str, fields: list[str], initial: DataFrame | None = None, ended: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """A row for each run whenever its events arrive: ``key``, its last ``order``, and the last known value of each field, types kept.

    Null never replaces a value, an earlier event never a later one, whenever it arrives; of equal times the greater value stays, so
    the result doesn't depend on arrival. Events without key or time are left out. Fields are of simple types. ``initial``, a batch table of the same columns with at most one row a
    run, is what is known before the first event. With ``ended``, a boolean field, a run that is over is forgotten ``keep_ms`` after the micro-batch that said so, unless a later event
    takes that back first; such a stream looks for timers again and again, so an ``availableNow`` trigger never ends it. Each task leaves a row a run of what it reads, and only those move. The session's state store becomes RocksDB, which typed state needs.
    """
    if (ended is None) != (keep_ms is None):
        raise ValueError("ended and keep_ms belong together")
    if nested := [f for f in fields if stream.schema[f].dataType.typeName() in ("struct", "array", "map", "variant")]:
        raise ValueError(f"fields of simple types only: {nested}")
    if ended is not None and (ended not in fields or stream.schema[ended].dataType != BooleanType()):
        raise ValueError(f"{ended} must be a boolean field")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events = _events(stream, key, order, fields)
    schema = StructType([StructField(f.name, f.dataType) for f in events.schema])
    out = StructType([StructField(c, stream.schema[c].dataType) for c in (key, order, *fields)])
    few = events.mapInArrow(_combine(len(fields), schema), schema)
    state = StatusState(StructType(schema.fields[1:]), out.names, None if ended is None else fields.index(ended), keep_ms)
    known = None if initial is None else _events(initial, key, order, fields).groupBy("key")
    return few.groupBy("key").transformWithState(state, out, "Update", "None" if ended is None else "ProcessingTime", known)
