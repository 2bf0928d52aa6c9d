"""CSV in byte ranges against the standard library's reader, with many ranges a file."""

import csv
import random

import pytest

from threadloom.sources import csv_ranges


def plain(paths):
    out, n = [], 0
    for p in paths:
        with open(p, encoding="utf-8") as f:
            rows = [r for r in csv.reader(f) if r]
        for r in rows[1:]:
            out.append((n, *[(r + [""] * 3)[i] for i in range(3)]))
            n += 1
    return out


def field(rng):
    parts = ["a", "é", " ", ",", '"', "\n", "\r\n", "\r", '""', '",', ',"', "word", "x" * 40]
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 12])))


def quoted(text, rng):
    if not any(c in text for c in ',"\n\r') and rng.random() < 0.6:
        return text
    return '"' + text.replace('"', '""') + '"'


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [97, 700, 1 << 20])
def test_random_files(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    paths = []
    for k in range(3):
        paths.append(tmp_path / f"f{k}.csv")
        rows = [",".join(quoted(field(rng), rng) for _ in range(rng.choice([2, 3, 3, 3, 4]))) for _ in range(60 * k + 5)]
        rows.insert(3, 'plain "inside",b"c,"closed"behind')
        rows.insert(4, "")
        rows.insert(5, '"' + "long\nfield, " * 60 + '",1,2')  # over several ranges
        paths[-1].write_bytes(("one,two,three\n" + "\n".join(rows) + ("\n" if k else "")).encode())
    small_ranges(size)
    got = csv_ranges.read_csv(spark, str(tmp_path))
    if size < 1000:
        assert got.sparkSession.read.text(str(tmp_path)).rdd.getNumPartitions() > 3 * len(paths)
    rows = sorted(tuple(x or "" if i else x for i, x in enumerate(r)) for r in got.collect())
    assert rows == plain(paths)


@pytest.mark.parametrize("text", ["a,b\n", "", 'a,b\n1,"never\ncloses,\n2', '"a\n1",b\n"x",\n,""\n', "\n\na,b\n\n1,2\n\n"])
@pytest.mark.parametrize("size", [3, 1 << 20])
def test_edges(spark, tmp_path, small_ranges, text, size):
    path = tmp_path / "e.csv"
    path.write_text(text)
    small_ranges(size)
    got = sorted(csv_ranges.read_csv(spark, str(path), ["a", "b"]).collect())
    with open(path) as f:
        want = [r for r in csv.reader(f) if r][1:]
    assert [(r["_rowidx"], r["a"] or "", r["b"] or "") for r in got] == [(i, *(r + [""])[:2]) for i, r in enumerate(want)]


def test_empty_fields(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text('a,b,c\n"",,\n1\n1,2,3,4\n')
    assert [tuple(r) for r in sorted(csv_ranges.read_csv(spark, str(path)).collect())] == [(0, "", None, None), (1, "1", None, None), (2, "1", "2", "3")]
