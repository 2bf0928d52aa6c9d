"""CSV with line ends inside quotes, read in byte ranges: many tasks a file, with the position of every row."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A field: quoted (doubled quotes inside, text behind the closing quote belongs to it), else plain.
_FIELD = re.compile(r'(?:"((?:[^"]++|"")*+)"([^,]*+)|([^,]*+))(,|\Z)')
#: A line that ends inside a quoted field, if it starts outside.
_OPEN = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+),)*+"(?:[^"]++|"")*+')
_RANGE = ("file", "start", "length")
_PLACE = ("inside", "first", "heads", "headed")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside (or outside) of quotes ends inside of them."""
    if '"' not in line:
        return inside
    return _OPEN.fullmatch('"' + line if inside else line) is not None


def cells(record: str) -> list[str | None]:
    """Fields of a record; an empty plain one is null, a record whose last quote never closes ends with it."""
    if '"' not in record:
        return [c or None for c in record.split(",")]
    if _OPEN.fullmatch(record):
        record += '"'
    out: list[str | None] = []
    for m in _FIELD.finditer(record):
        quoted, behind, plain, end = m.groups()
        out.append(plain or None if quoted is None else quoted.replace('""', '"') + behind)
        if not end:
            break
    return out


def _ranges(batches):
    """(range, its columns' first row, lines) of each stretch of rows that one byte range gave."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _RANGE), strict=True))
        lines = [v.decode("utf-8", "replace") for v in batch.column("value").to_pylist()]
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            yield keys[at], batch.slice(at, 1), lines[at:to]
            at = to


def _probe(batches):
    """Arrow function: of each range, for a start outside (0) and inside (1) of quotes, where it ends and how many records start in it."""
    now, ends, n = None, [False, True], [0, 0]

    def told():
        cols = [[x] for x in (*now, ends[0], ends[1], *n)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], [*_RANGE, "end0", "end1", "n0", "n1"])

    for key, _, lines in _ranges(batches):
        if key != now:
            if now is not None:
                yield told()
            now, ends, n = key, [False, True], [0, 0]
        for line in lines:
            for s in (0, 1):
                n[s] += not ends[s] and line != ""
                ends[s] = ends_inside(line, ends[s])
    if now is not None:
        yield told()


def _emit(whole: bool):
    """Arrow function: rows of records that lie in one range (``whole``), else the parts of those that go over its ends."""

    def packed(rows):
        if whole:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["ordinal", "cells"])
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["raw", "ordinal", "header", "start", "text"])

    def run(batches):
        now, held, rows, size = None, [], [], 0
        for key, head, lines in _ranges(batches):
            if key != now:
                if held and not whole:
                    rows.append((raw, raw - heads, raw == title, now[1], "\n".join(held)))
                now, held = key, []
                inside, first, heads, headed = (head.column(c)[0].as_py() for c in _PLACE)
                if inside is None:
                    raise ValueError(f"byte ranges of {key[0]} changed between the passes")
                raw, title, cut = first - 1, first if headed else -1, inside
            for line in lines:
                if not inside:
                    if line == "":
                        continue
                    raw, cut = raw + 1, False
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    if whole and not cut and raw != title:
                        rows.append((raw - heads, cells("\n".join(held))))
                        size += sum(map(len, held))
                    elif not whole and cut:
                        rows.append((raw, raw - heads, raw == title, now[1], "\n".join(held)))
                    held, cut = [], False
                    if len(rows) >= 4096 or size > 1 << 22:
                        yield packed(rows)
                        rows, size = [], 0
        if held and not whole:
            rows.append((raw, raw - heads, raw == title, now[1], "\n".join(held)))
        if rows:
            yield packed(rows)
    return run


def _parse(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("ordinal"), pa.array([cells(t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], ["ordinal", "cells"])


def _places(probed: DataFrame) -> DataFrame:
    """What a range needs to know: whether it starts inside quotes, the number of records before it, of headers up to it, and whether it holds its file's header.

    What a range does to the state is one of four: keep, swap, or end outside or inside from either start. So the state
    before a range is that of the last fixed end, turned by the swaps since: sums over the ranges, one row each.
    """
    file = Window.partitionBy("file").orderBy("start")
    before, upto = file.rowsBetween(Window.unboundedPreceding, -1), file.rowsBetween(Window.unboundedPreceding, 0)
    swap = (F.col("end0") & ~F.col("end1")).cast("int")
    fixed = F.when(F.col("end0") == F.col("end1"), (F.col("end0").cast("int") + F.sum(swap).over(upto)) % 2)
    rows = probed.withColumn("fixed", fixed).withColumn("turns", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    rows = rows.withColumn("inside", (F.coalesce(F.last("fixed", True).over(before), F.lit(0)) + F.col("turns")) % 2 == 1)
    rows = rows.withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")))
    rows = rows.withColumn("headed", (F.coalesce(F.sum("n").over(before), F.lit(0)) == 0) & (F.col("n") > 0))
    every = Window.orderBy("file", "start")
    return rows.select(
        *_RANGE, "inside", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum(F.col("headed").cast("long")).over(every.rowsBetween(Window.unboundedPreceding, 0)).alias("heads"), "headed")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, ordinal: str = "_rowidx") -> DataFrame:
    """UTF-8 CSV with a header in each file as string columns, and each row's 0-based position over all files by name.

    A file is read in ranges of ``spark.sql.files.maxPartitionBytes``. Where a range starts, inside or outside of quotes, is unknown
    at first, so a first pass finds for both what it leads to; sums over the ranges (a row each, the only table that is broadcast) settle
    it, and a second pass gives the records. Those that go over a range's end are joined from their parts. Line ends of any kind come back as
    ``\\n``, inside quotes too. Doubled quotes stand for one; a quote inside a plain field is a character. Empty plain
    fields and those that a short row lacks are null, further ones of a long row are left out, blank lines are no rows. A quote that never
    closes takes the rest of its file. All files must have the columns of the first; ``columns`` names them, else its header does.
    """
    names = columns or spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").csv(path).columns
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("value"))
    places = _places(lines.mapInArrow(_probe, "file string, start long, length long, end0 boolean, end1 boolean, n0 long, n1 long"))
    placed = lines.join(F.broadcast(places), list(_RANGE), "left")  # a row a range
    whole = placed.mapInArrow(_emit(True), "ordinal long, cells array<string>")
    parts = placed.mapInArrow(_emit(False), "raw long, ordinal long, header boolean, start long, text string")
    joined = parts.groupBy("raw").agg(F.min("ordinal").alias("ordinal"), F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p")).where("not header")
    joined = joined.select("ordinal", F.array_join(F.col("p.text"), "\n").alias("text")).mapInArrow(_parse, "ordinal long, cells array<string>")
    return whole.unionByName(joined).select(F.col("ordinal").alias(ordinal), *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)])
