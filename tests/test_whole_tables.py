"""Registered queries cover their whole tables; against plain models."""

import random

import pytest

from threadloom.operators import schedule
from threadloom.plans.queries import QUERIES


def put(spark, path, **tables):
    for name, (rows, cols) in tables.items():
        spark.createDataFrame(rows, cols).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def planned(rows):
    best, frozen, out = None, False, {}
    for at, total, done in rows:
        if not frozen and total is not None and (best is None or total > best):
            best = total
        out[at] = best
        frozen = frozen or bool(done)
    return out


@pytest.mark.parametrize("stop", [None, 0, 37, 299])
def test_extension_by_ranges(spark, stop):
    rng = random.Random(5)
    keys = [None, *sorted(rng.sample(range(-200, 900), 299))]
    rows = [(k, None if rng.random() < 0.2 else rng.randrange(1000) + i // 3, True if i == stop else rng.choice([False, None])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(random.Random(6).sample(rows, len(rows)), "event long, total long, done boolean")
    got = {r["event"]: r["planned"] for r in schedule.extend_only(df, width=16).collect()}
    assert got == planned(rows)


def test_whole_tables(spark, tmp_path):
    events = [(i, 7 * i % 95 + (i > 450), "view") for i in range(1200)]
    orders = [(k, k % 60) for k in range(1, 4000)]
    turns = [(1, 0, "user", "a b c"), (1, 1, "assistant", "one two three four five six seven eight nine ten"), (2, 0, "user", "x")]
    d = put(spark, tmp_path, events=(events, "event_id long, user_id long, event_type string"), orders=(orders, "o_orderkey long, o_custkey long"), conversations=(turns, "conv_id long, turn long, role string, text string"))
    got = {r["event_id"]: (r["projected"], r["source"]) for r in QUERIES["projected_samples"](spark, d).collect()}
    assert len(got) == 1200 and got[1197] == (1197, "meta")
    got = {r["event_id"]: r["planned"] for r in QUERIES["scheduler_extension"](spark, d).collect()}
    assert got == planned([(i, u, i == 300) for i, u, _ in events])
    latest = {}
    for k, c in orders:
        if k % 3 < 2:
            folder = latest.setdefault(f"models/m{c % 50}", [0, False])
            folder[0], folder[1] = max(folder[0], k), folder[1] or k % 3 == 0
    best = min(latest, key=lambda f: (-latest[f][0], f))
    assert QUERIES["latest_valid_model"](spark, d).first()[0] == best + ("/merged" if latest[best][1] else "")
    got = {r["conv_id"]: (r["prompt_tokens"], r["completion_tokens"], r["total_tokens"]) for r in QUERIES["usage_counts"](spark, d).collect()}
    assert got == {1: (10, 10, 20), 2: (1, 1, 2)}
