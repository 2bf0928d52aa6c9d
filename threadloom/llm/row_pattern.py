"""Row pattern matching over each key's rows in order: a right-to-left table, and a forward walk that never backtracks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm._batches import sliced
from threadloom.llm._store import forget, written

_NEVER, _ALWAYS = -(2**63), 2**63 - 1
_ROW = ("key", "at", "id", "cents", "mask")


@dataclass(frozen=True)
class Letter:
    """What a row must be for one letter of the pattern, and how often it stands there.

    ``test``: SQL condition on the row's own columns. ``step``: its cents lie below (-1) or above (1) those of the row before, 0: anywhere.
    ``within``: at most so many microseconds after the row before. ``as_first``: at least the cents of the match's first row.
    ``many``: one or more such rows, as many as can be. Rows without cents fit no letter.
    """

    name: str
    test: str = "true"
    step: int = 0
    within: int | None = None
    as_first: bool = False
    many: bool = False


@dataclass
class Rows:
    """Rows in order, as arrays; bit s of ``mask`` tells whether the row passes the own test of letter s."""

    key: np.ndarray
    at: np.ndarray
    id: np.ndarray
    cents: np.ndarray
    mask: np.ndarray

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, part) -> Rows:
        return Rows(*(getattr(self, f)[part] for f in _ROW))

    def then(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in _ROW))

    @classmethod
    def of(cls, table) -> Rows:
        return cls(*(np.asarray(table.column(f)).astype(np.int64) for f in _ROW))


@dataclass
class Walks:
    """Matches under way: their first row and where it lies, what they have taken, and the row they stand on."""

    key: np.ndarray
    origin: np.ndarray
    start: np.ndarray
    first_id: np.ndarray
    first_cents: np.ndarray
    sum_cents: np.ndarray
    state: np.ndarray
    taken: np.ndarray
    at: np.ndarray
    id: np.ndarray
    cents: np.ndarray
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, part) -> Walks:
        return Walks(*(getattr(self, f)[part] for f in self.__dataclass_fields__))

    def step(self, to: np.ndarray, rows: Rows) -> Walks:
        row, taken = self.row + 1, self.taken.copy()
        taken[np.arange(len(to)), to] += 1
        return Walks(self.key, self.origin, self.start, self.first_id, self.first_cents, self.sum_cents + rows.cents[row], to, taken, rows.at[row], rows.id[row], rows.cents[row], row)

    @classmethod
    def begin(cls, rows: Rows, at: np.ndarray, origin: int, base: int, states: int) -> Walks:
        taken = np.zeros((len(at), states), np.int64)
        taken[:, 0] = 1
        cents = rows.cents[at]
        return cls(rows.key[at], np.full(len(at), origin), base + at, rows.id[at], cents, cents, np.zeros(len(at), np.int64), taken, rows.at[at], rows.id[at], cents, at)

    @classmethod
    def of(cls, table) -> Walks:
        one = lambda c: np.asarray(table.column(c)).astype(np.int64)
        taken = np.array(table.column("taken").to_pylist(), np.int64).reshape(table.num_rows, -1)
        return cls(*(taken if f == "taken" else np.full(table.num_rows, -1) if f == "row" else one(f) for f in cls.__dataclass_fields__))


class Automaton:
    """A pattern's states: state s has just taken a row for letter s, the last one has succeeded.

    ``table`` holds, for each state and row, the most cents that a match's first row may have so that the match, standing there, still succeeds.
    """

    def __init__(self, letters: tuple[Letter, ...]):
        first = letters[0]
        if len(letters) < 2 or len(letters) > 60 or first.many or first.as_first or first.step or first.within is not None:
            raise ValueError("a pattern is one first row, whose letter looks at no other row, and one to 59 further letters")
        self.letters, self.n = letters, len(letters)
        #: Moves of each state, the preferred one first: the same letter again, then the next one.
        self.moves = [([s] if x.many else []) + ([s + 1] if s + 1 < self.n else []) for s, x in enumerate(letters)]
        #: Values of a row behind which nothing fits: only a match that has succeeded already does.
        self.ended = np.array([_NEVER] * (self.n - 1) + [_ALWAYS])

    def fits(self, rows: Rows, prev: Rows) -> np.ndarray:
        """Array (letters, rows): whether a row fits each letter behind the row of ``prev`` at the same place. The first letter stands behind none."""
        out = np.zeros((self.n, len(rows)), bool)
        beside = (rows.key == prev.key) & (prev.mask != 0)
        for s, x in enumerate(self.letters[1:], 1):
            ok = beside & (rows.mask >> s & 1 == 1)
            if x.step:
                ok &= rows.cents > prev.cents if x.step > 0 else rows.cents < prev.cents
            if x.within is not None:
                ok &= rows.at - prev.at <= x.within
            out[s] = ok
        return out

    def among(self, rows: Rows) -> np.ndarray:
        """``fits`` of consecutive rows; the first one fits nothing."""
        fit = self.fits(rows, rows[np.maximum(np.arange(len(rows)) - 1, 0)])
        fit[:, :1] = False
        return fit

    def behind(self, fit: np.ndarray, cents: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Values (states, rows) of rows whose next rows fit as told and have these cents and values."""
        out = np.repeat(self.ended[:, None], fit.shape[1], axis=1)
        for s in range(self.n - 1):
            for t in self.moves[s]:
                can = np.minimum(value[t], cents) if self.letters[t].as_first else value[t]
                out[s] = np.maximum(out[s], np.where(fit[t], can, _NEVER))
        return out

    def table(self, rows: Rows, fit: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Values (states, rows) from right to left; ``last`` are those of the last row.

        A row that fits no letter cuts the rows in two. The parts are filled side by side, by the distance from their ends.
        """
        n = len(rows)
        out = np.repeat(self.ended[:, None], n, axis=1)
        if not n:
            return out
        out[:, -1] = last
        ends = np.append(np.flatnonzero(~fit[:, 1:].any(axis=0)), n - 1)
        far = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
        order, upto = np.argsort(far, kind="stable"), np.cumsum(np.bincount(far))
        for a, b in zip(upto, upto[1:], strict=False):
            at = order[a:b]
            out[:, at] = self.behind(fit[:, at + 1], rows.cents[at + 1], out[:, at + 1])
        return out

    def starts(self, rows: Rows, table: np.ndarray) -> np.ndarray:
        """Rows where a match begins."""
        return np.flatnonzero((rows.mask & 1 == 1) & (table[0] >= rows.cents))

    def walk(self, rows: Rows, fit: np.ndarray, table: np.ndarray, w: Walks) -> Iterator[tuple[bool, Walks]]:
        """Steps walks forward, each by the preferred move that can still succeed; gives (True, walks) that ended and (False, walks) that stand on the last row."""
        while len(w):
            ready = (w.state == self.n - 1) & (not self.letters[-1].many)
            if ready.any():
                yield True, w[ready]
                w = w[~ready]
            out = w.row + 1 >= len(rows)
            if out.any():
                yield False, w[out]
                w = w[~out]
            nxt, to = w.row + 1, np.full(len(w), -1)
            for s in range(self.n):
                for t in reversed(self.moves[s]):  # the preferred move is written last
                    can = fit[t, nxt] & (table[t, nxt] >= w.first_cents)
                    if self.letters[t].as_first:
                        can &= rows.cents[nxt] >= w.first_cents
                    to = np.where((w.state == s) & can, t, to)
            stay = to < 0  # a last letter that may repeat, in front of a row that it doesn't take
            if stay.any():
                yield True, w[stay]
                w, to = w[~stay], to[~stay]
            w = w.step(to, rows)


_SCHEMA = (
    "role string, part int, at_row long, key long, at long, id long, cents long, mask long, state int, taken array<long>, "
    "first_id long, first_cents long, sum_cents long, origin int, start long, low array<long>, high array<array<long>>")
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]
_ARROW = {"role": pa.string(), "part": pa.int32(), "state": pa.int32(), "taken": pa.list_(pa.int64()), "origin": pa.int32(), "low": pa.list_(pa.int64()), "high": pa.list_(pa.list_(pa.int64()))}


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of the common columns; those that aren't given are null."""
    kind = lambda c: _ARROW.get(c, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind(c)) if c in columns else pa.nulls(n, kind(c)) for c in _NAMES], _NAMES)


def _rows(role: str, rows: Rows, part: int, base: int = 0, **more) -> pa.RecordBatch:
    n = len(rows)
    return _batch(n, role=[role] * n, part=[part] * n, at_row=base + np.arange(n), **{f: getattr(rows, f) for f in _ROW}, **more)


def _walks(role: str, w: Walks, part: int | None) -> pa.RecordBatch:
    n = len(w)
    own = {f: getattr(w, f) for f in ("key", "at", "id", "cents", "first_id", "first_cents", "sum_cents", "start")}
    return _batch(n, role=[role] * n, part=[part] * n, state=w.state.tolist(), taken=w.taken.tolist(), origin=w.origin.tolist(), **own)


def _first_pass(auto: Automaton):
    """Arrow function over a sorted partition, which it divides into parts that no match crosses and holds one or few of at a time.

    Matches in whole parts are done at once. The rows before the first cut (``head``) and behind the last one (``tail``), or all of them if
    there is no cut (``through``), are given back for the partitions beside, and a row for its begin and end with what ``_settle`` needs.
    """

    def run(batches):
        from pyspark import TaskContext

        part, held, base, first, low = TaskContext.get().partitionId(), None, 0, None, None
        for batch in sliced(batches, 16_384):
            if not batch.num_rows:
                continue
            rows = Rows.of(batch)
            rows = rows if held is None else held.then(rows)
            first = rows[:1] if first is None else first
            fit = auto.among(rows)
            cuts = np.flatnonzero(~fit[:, 1:].any(axis=0)) + 1
            if not len(cuts):
                held = rows
                continue
            end = int(cuts[-1])
            table = auto.table(rows[:end], fit[:, :end], auto.ended)
            if low is None:
                yield _rows("head", rows[: cuts[0]], part, base)
                low = table[:, 0].tolist()
            for _, w in auto.walk(rows[:end], fit[:, :end], table, Walks.begin(rows, auto.starts(rows[:end], table), part, base, auto.n)):
                yield _walks("done", w, part)
            base, held = base + end, rows[end:]
        if held is None:
            return
        high, role = [low] * auto.n, "tail"
        if low is None:
            fit, role = auto.among(held), "through"
            low = auto.table(held, fit, auto.ended)[:, 0].tolist()
            high = [auto.table(held, fit, np.where(np.arange(auto.n) == t, _ALWAYS, auto.ended))[:, 0].tolist() for t in range(auto.n)]
        yield _rows(role, held, part, base)
        yield _rows("begin", first, part, low=[low], high=[high])
        yield _rows("end", held[len(held) - 1 :], part)
    return run


def _settle(auto: Automaton):
    """Arrow function over partitions (``part, last, low, high, next, next_first, next_value``): the values of the last row and of the first."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                last = auto.ended
                if r["next"] is not None:
                    a, b = (Rows(*(np.array([r[x][f]]) for f in _ROW)) for x in ("last", "next_first"))
                    last = auto.behind(auto.fits(b, a), b.cents, np.array(r["next_value"])[:, None])[:, 0]
                value = np.maximum(r["low"], np.minimum(np.array(r["high"]), last[:, None]).max(axis=0))
                out.append((r["part"], last.tolist(), value.tolist(), value.tolist() != r["value"]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.bool_())], ["part", "last_value", "value", "moved"])
    return run


def _ends(got: DataFrame, auto: Automaton) -> DataFrame:
    """``part, next, last_value`` of each partition that has rows, a row each: how its last row is continued.

    What the last row may expect depends on the next partition's first row, whose values depend on that one's last row only where
    rows pass through it without a cut; so values are handed on from right to left until none changes.
    """
    row = F.struct(*_ROW)
    begin = got.where("role = 'begin'").select("part", row.alias("first"), "low", "high", F.lead("part").over(Window.orderBy("part")).alias("next"))
    ends = written(begin.join(got.where("role = 'end'").select("part", row.alias("last")), "part"), "parts")
    values = written(ends.select("part", F.col("low").alias("value"), F.lit(None).cast("array<long>").alias("last_value"), F.lit(True).alias("moved")), "values")
    while not values.where("moved").isEmpty():
        nxt = ends.select(F.col("part").alias("next"), F.col("first").alias("next_first")).join(values.select(F.col("part").alias("next"), F.col("value").alias("next_value")), "next")
        asked = ends.join(values.select("part", "value"), "part").join(nxt, "next", "left").select("part", "last", "low", "high", "value", "next", "next_first", "next_value")
        new = written(asked.mapInArrow(_settle(auto), "part int, last_value array<long>, value array<long>, moved boolean"), "values")
        forget(values)
        values = new
    return ends.select("part", "next").join(values.select("part", "last_value"), "part")


def _sorted(table) -> tuple[Rows, int, np.ndarray, int | None]:
    table = table.sort_by("at_row")
    one = table.slice(0, 1).to_pylist()[0]
    return Rows.of(table), one["at_row"], np.array(one["last_value"]), one["next"]


def _carried(auto: Automaton, rows: Rows, fit: np.ndarray, table: np.ndarray, w: Walks, nxt: int | None) -> pa.Table:
    out = [_batch(0)]
    for ended, x in auto.walk(rows, fit, table, w):
        out.append(_walks("done" if ended or nxt is None else "open", x, nxt))
    return pa.Table.from_batches(out)


def _from_tail(auto: Automaton):
    """Grouped function: matches that begin in the rows behind a partition's last cut."""

    def run(table):
        rows, base, last, nxt = _sorted(table)
        fit = auto.among(rows)
        values = auto.table(rows, fit, last)
        return _carried(auto, rows, fit, values, Walks.begin(rows, auto.starts(rows, values), table.column("part")[0].as_py(), base, auto.n), nxt)
    return run


def _into_head(auto: Automaton):
    """Cogrouped function: walks that come from the partition before go on in this one's rows before its first cut."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch(0)])
        w = Walks.of(left)
        rows, _, last, nxt = _sorted(right)
        stood = Rows(w.key[:1], w.at[:1], w.id[:1], w.cents[:1], np.ones(1, np.int64))  # all stand on the last row before
        fit = auto.among(rows)
        fit[:, :1] = auto.fits(rows[:1], stood)
        return _carried(auto, rows, fit, auto.table(rows, fit, last), w, nxt)
    return run


def match_rows(
    events: DataFrame, letters: tuple[Letter, ...], key: str = "client_id", ts: str = "ts", row_id: str = "click_id", value: str = "value",
) -> DataFrame:
    """Matches of the pattern ``letters`` over each key's distinct rows in order of ``ts``, ``row_id``.

    ``client_id, match_no, first_id, last_id, n_rows, sum_cents, labels`` and ``taken``, the number of rows of each letter. Cents are ``floor(100 * value + 0.5)``; a
    row whose value is null, not a number or beyond 64 bits of cents fits no letter. Repeated letters take as many rows as they can and give back
    what later letters need, as regular expressions that backtrack do; each row begins one match at most, and ``match_no`` counts a
    key's matches from 1. Rows with a null key or time are dropped, rows that are alike in all columns are one. Rows that share key, time and
    id but differ elsewhere are ordered by cents, then by their tests. An empty table gives no row.

    Rows are dealt out in ranges of the whole order, so a key with any share of them is divided among tasks. A row that fits no letter
    behind its predecessor cuts them into parts that no match crosses; only what stands between a partition's outer cuts and its ends meets the partitions beside,
    one handing on to the next until every walk has ended.
    """
    auto = Automaton(letters)
    spark = events.sparkSession
    cents = F.floor(F.col(value) * 100 + 0.5)
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < 9e16)
    tests = [F.when(known & F.coalesce(F.expr(x.test), F.lit(False)), F.lit(1 << s)).otherwise(F.lit(0)).cast("long") for s, x in enumerate(letters)]
    mask: Column = tests[0]
    for t in tests[1:]:
        mask = mask.bitwiseOR(t)
    one = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).distinct()
    rows = one.select(
        F.col(key).cast("long").alias("key"), F.col(ts).alias("at"), F.col(row_id).cast("long").alias("id"),
        F.when(known, cents).otherwise(0).cast("long").alias("cents"), mask.alias("mask"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("key", "at", "id", "cents", "mask")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    got = written(ranged.withColumn("id", F.coalesce("id", F.lit(_NEVER))).mapInArrow(_micros(_first_pass(auto)), _SCHEMA), "first")
    ends = written(_ends(got, auto), "ends")
    edges = written(got.where("role in ('head', 'tail', 'through')").select("role", "part", "at_row", *_ROW).join(ends, "part"), "edges")
    done = [got.where("role = 'done'")]
    step = written(edges.where("role in ('tail', 'through')").groupBy("part").applyInArrow(_from_tail(auto), _SCHEMA), "walks")
    while True:
        done.append(step.where("role = 'done'"))
        open_ = step.where("role = 'open'")
        if open_.isEmpty():
            break
        step = written(open_.groupBy("part").cogroup(edges.where("role in ('head', 'through')").groupBy("part")).applyInArrow(_into_head(auto), _SCHEMA), "walks")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return _numbered(found, letters)


def _micros(inner):
    """Gives the function times as whole microseconds, whatever the zone."""

    def run(batches):
        def plain():
            for b in batches:
                yield pa.RecordBatch.from_arrays([c.cast(pa.timestamp("us", c.type.tz)).cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in b.columns], b.schema.names)
        yield from inner(plain())
    return run


def _numbered(found: DataFrame, letters: tuple[Letter, ...]) -> DataFrame:
    """Numbers the matches of each key: inside a partition by their first rows, after those of the partitions before."""
    own = F.row_number().over(Window.partitionBy("key", "origin").orderBy("start"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("origin").rowsBetween(Window.unboundedPreceding, -1))
    many = found.groupBy("key", "origin").agg(F.count("*").alias("n")).select("key", "origin", F.coalesce(before, F.lit(0)).alias("before"))
    placed = found.withColumn("k", own).join(many, ["key", "origin"])
    labels = F.concat(*[F.repeat(F.lit(x.name), F.element_at("taken", s + 1).cast("int")) for s, x in enumerate(letters)])
    id_of = lambda c: F.when(F.col(c) != _NEVER, F.col(c))
    return placed.select(
        F.col("key").alias("client_id"), (F.col("before") + F.col("k")).cast("long").alias("match_no"), id_of("first_id").alias("first_id"), id_of("id").alias("last_id"),
        F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_rows"), "sum_cents", labels.alias("labels"), "taken")


_FIVE = 5 * 60 * 1_000_000
#: The letters of the click pattern ``A D+ U+ P``.
CLICK_PATTERN = (
    Letter("A"),
    Letter("D", "kind is not null and kind != 'error'", step=-1, within=_FIVE, many=True),
    Letter("U", "kind is not null and kind != 'error'", step=1, within=_FIVE, many=True),
    Letter("P", "kind = 'click'", within=_FIVE, as_first=True),
)


def digest(matches: DataFrame) -> DataFrame:
    """Matches with a digest of their labels."""
    return matches.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2(F.col("labels").cast("binary"), 256).alias("labels_sha256"))
