"""Typed status as a stream: types, order of arrival, restarts, an initial table, timers."""

import itertools
import math
import random
import time
from datetime import datetime
from decimal import Decimal

import pytest

from threadloom.plans.queries import QUERIES
from threadloom.streaming import jobs, status

SCHEMA = "run string, at long, phase string, step long, loss double, price decimal(20,4), seen timestamp_ntz, over boolean"
FIELDS = ["phase", "step", "loss", "price", "seen", "over"]


def run(spark, tmp_path, **more):  # without timers, which keep a stream going for ever
    got = {}
    stream = status.merge_status(jobs.follow(spark, str(tmp_path / "in"), SCHEMA, 1), "run", "at", FIELDS, **more)
    assert stream.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: got.update({r["run"]: tuple(r)[1:] for r in df.collect()}))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return got


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def model(rows):
    out = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        o = out.setdefault(r[0], [None, *[None] * 6])
        o[0] = r[1] if o[0] is None else max(o[0], r[1])
        for i, v in enumerate(r[2:], 1):
            rank = (r[1], v != v, v)
            if v is not None and (o[i] is None or rank > o[i]):
                o[i] = rank
    return {k: (o[0], *[x and x[2] for x in o[1:]]) for k, o in out.items()}


def plain(d):
    return {k: tuple("NaN" if isinstance(x, float) and math.isnan(x) else x for x in v) for k, v in d.items()}


def test_any_order_of_arrival_restarts_and_types(spark, tmp_path):
    rng = random.Random(3)
    some = lambda v: rng.choice([None, v, v])
    rows = [
        (some("hot") if rng.random() < 0.4 else f"r{rng.randrange(12)}", some(rng.randrange(40)), some(rng.choice(["", "ä", "b"])), some(2**60 + rng.randrange(9)), some(rng.choice([math.nan, -1.5, 2.0])),
         some(Decimal(rng.randrange(999)).scaleb(-4)), some(datetime(2024, 1, 1, 0, 0, rng.randrange(60), 5)), some(rng.random() < 0.5))
        for _ in range(600)]
    got = {}
    for part in itertools.batched(rows, 200):  # a new stream on the same checkpoint each time
        add(spark, tmp_path, list(part))
        got |= run(spark, tmp_path)
    assert plain(got) == plain(model(rows)) and len(got) == 13
    assert isinstance(got["hot"][2], int) and got["hot"][2] >= 2**60 and isinstance(got["hot"][4], Decimal)
    add(spark, tmp_path, [(None, 1, "x", *[None] * 5), ("r1", None, "x", *[None] * 5)])
    assert run(spark, tmp_path) == {}


def test_initial_table(spark, tmp_path):
    known = spark.createDataFrame([("a", 5, "old", 7, *[None] * 4), ("b", 9, "late", *[None] * 5)], SCHEMA)
    add(spark, tmp_path, [("a", 6, None, 8, *[None] * 4), ("b", 3, "early", 1, *[None] * 4), ("c", 1, *[None] * 6)])
    assert run(spark, tmp_path, initial=known) == {"a": (6, "old", 8, *[None] * 4), "b": (9, "late", 1, *[None] * 4), "c": (1, *[None] * 6)}


def test_ended_runs_are_forgotten(spark, tmp_path):
    got, end = {}, time.time() + 60
    add(spark, tmp_path, [("gone", 5, "x", 7, None, None, None, True), ("stays", 5, "y", 7, None, None, None, False)])
    stream = status.merge_status(jobs.follow(spark, str(tmp_path / "in"), SCHEMA, 1), "run", "at", FIELDS, ended="over", keep_ms=1)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: got.update({r["run"]: (i, *tuple(r)[1:]) for r in df.collect()}))
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        while "gone" not in got or (q.lastProgress or {"batchId": 0})["batchId"] < got["gone"][0] + 2:  # the timer has fired in a later micro-batch
            assert q.isActive and time.time() < end
            time.sleep(0.1)
        assert got["gone"][1:4] == (5, "x", 7)
        add(spark, tmp_path, [("gone", 1, None, 1, *[None] * 4), ("stays", 6, None, 8, *[None] * 4)])
        while got["stays"][1] == 5:
            assert q.isActive and time.time() < end
            time.sleep(0.1)
    finally:
        q.stop()
    assert got["gone"][1:] == (1, None, 1, *[None] * 4) and got["stays"][1:] == (6, "y", 8, None, None, None, False)


def test_refusals(spark, tmp_path):
    df = spark.createDataFrame([], "k string, at long, a array<int>, s string")
    for fields, more in ((["a"], {}), (["s"], {"ended": "s", "keep_ms": 1}), (["s"], {"ended": "s"})):
        with pytest.raises(ValueError):
            status.merge_status(df, "k", "at", fields, **more)


def test_query_on_broken_rows(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 2), datetime(2024, 1, 3), 7, "view", None), (2, datetime(2024, 1, 1), datetime(2024, 1, 4), 7, "click", "{"), (3, None, None, 7, "cart", "x"), (4, datetime(2024, 1, 1), None, None, "a", "b")]
    spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, props string").write.parquet(f"{tmp_path}/clicks.parquet")
    assert [tuple(r) for r in QUERIES["replayed_status"](spark, str(tmp_path)).collect()] == [(7, "2024-01-02 00:00:00.000000", 1, "view", "{")]
