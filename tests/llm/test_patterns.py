"""Row patterns against a plain backtracking matcher, with keys divided among many partitions."""

import datetime as dt
import hashlib
import math
import random
import sys

import pytest

from threadloom.llm import row_pattern as R

T0 = dt.datetime(2024, 1, 1)
sys.setrecursionlimit(10_000)  # of the plain matcher


def _plain(rows, letters=R.CLICK_PATTERN):
    """Backtracking over each client's distinct rows, one start after the other."""
    tests = {"A": lambda k: True, "D": lambda k: k is not None and k != "error", "U": lambda k: k is not None and k != "error", "P": lambda k: k == "click"}
    by = {}
    for r in set(rows):
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], []).append(r)
    out = []
    for client, own in by.items():
        own.sort(key=lambda r: (r[1], r[2]))
        cents = [math.floor(100 * r[4] + 0.5) if r[4] is not None and math.isfinite(r[4]) else None for r in own]

        def fits(x, i, a):
            if i >= len(own) or cents[i] is None or not tests[x.name](own[i][3]):
                return False
            if x.step and not (cents[i] - cents[i - 1]) * x.step > 0:
                return False
            if x.within is not None and (own[i][1] - own[i - 1][1]) > dt.timedelta(microseconds=x.within):
                return False
            return not x.as_first or cents[i] >= a

        def ahead(s, i, a, said):
            if s == len(letters):
                return said
            if not fits(letters[s], i, a):
                return None
            if letters[s].many:
                more = ahead(s, i + 1, a, said + letters[s].name)
                if more is not None:
                    return more
            return ahead(s + 1, i + 1, a, said + letters[s].name)

        n = 0
        for i in range(len(own)):
            if cents[i] is not None and (said := ahead(1, i + 1, cents[i], letters[0].name)) is not None:
                n += 1
                out.append((client, n, own[i][2], own[i + len(said) - 1][2], len(said), sum(cents[i : i + len(said)]), said))
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(c, t, i, k, v, "x") for c, t, i, k, v in rows], "client_id long, ts timestamp_ntz, click_id long, kind string, value double, labels string")


def _got(df, letters=R.CLICK_PATTERN):
    return sorted(tuple(r)[:7] for r in R.match_rows(df, letters).collect())


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_random_rows(spark, many_parts):
    rng = random.Random(5)
    rows, t = [], T0
    for i in range(5000):
        t += dt.timedelta(seconds=rng.choice([0, 1, 30, 5, 7, 299, 300, 301]), microseconds=rng.choice([0, 0, 1]))
        client = rng.choice([1] * 9 + [2, 3, None])
        rows.append((client, None if rng.random() < 0.01 else t, i, rng.choice(["click"] * 5 + ["view"] * 3 + ["error", None]), rng.choice([None, float("nan"), 0.005, 5.5, 6.0, 6.5, 8.0, 9.0, 10.0, 1.115, 2.0, 2.5, 3.25, 4.0, -1.0, 7.0])))
    rows += rng.sample(rows, 200)  # repeated rows
    want = _plain(rows)
    assert len(want) > 30
    assert _got(_frame(spark, rows).repartition(4)) == want


def test_runs_longer_than_partitions(spark, many_parts):
    values = [500 - k for k in range(400)] + [101.5 + 0.5 * k for k in range(700)] + [50, 40, 45, 46, 500]
    kinds = ["click" if k % 97 == 0 or k > len(values) - 3 else "view" for k in range(len(values))]
    rows = [(7, T0 + dt.timedelta(seconds=k), k, kinds[k], float(v)) for k, v in enumerate(values)]
    want = _plain(rows)
    assert max(r[4] for r in want) > 900 and len(want) > 300
    assert _got(_frame(spark, rows)) == want
    matches = R.digest(R.match_rows(_frame(spark, rows), R.CLICK_PATTERN)).where("match_no = 1").first()
    assert matches["labels_sha256"] == hashlib.sha256(want[0][6].encode()).hexdigest()


def test_other_patterns(spark, many_parts):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2]), T0 + dt.timedelta(seconds=20 * k), k, rng.choice(["click", "view"]), float(rng.randint(1, 9))) for k in range(600)]
    short = (R.Letter("A"), R.Letter("P", "kind = 'click'", as_first=True))
    ends_open = (R.Letter("A"), R.Letter("D", "kind is not null", step=-1), R.Letter("U", "kind is not null", step=1, as_first=True, many=True))
    for letters in (short, ends_open):
        want = _plain(rows, letters)
        assert want and _got(_frame(spark, rows), letters) == want
    with pytest.raises(ValueError):
        R.Automaton((R.Letter("A", many=True), R.Letter("B")))


def test_edges(spark):
    empty = _frame(spark, [])
    assert R.match_rows(empty, R.CLICK_PATTERN).collect() == []
    one = [(1, T0 + dt.timedelta(seconds=k), k, "click", v) for k, v in enumerate([3.0, 2.0, 2.5, 3.0])]
    assert _got(_frame(spark, one)) == [(1, 1, 0, 3, 4, 1050, "ADUP")]
    assert _got(_frame(spark, [(1, T0, None, "click", 1e300), (None, T0, 1, None, None)])) == []
