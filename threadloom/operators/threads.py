"""Thread forests: root, depth and path of every row by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import norm_text, normalize_id
from threadloom.sources.store import forget, written

FIELDS = ("system", "Benutzer", "Kontext", "Assistentin")


def normalise_rows(rows: DataFrame) -> DataFrame:
    """Thread rows with normalised ids and texts; missing columns are empty. Needs ``id`` and ``_rowidx``."""
    has = set(rows.columns)
    text = [(norm_text(F.col(c)) if c in has else F.lit("")).alias(c) for c in FIELDS]
    parent = normalize_id(F.col("parent_id")) if "parent_id" in has else F.lit("")
    return rows.select("_rowidx", normalize_id(F.col("id")).alias("id"), parent.alias("parent_id"), *text)


def last_by_id(rows: DataFrame) -> DataFrame:
    """The row of each id that later rows see: the last one."""
    return rows.where("id != ''").groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "_rowidx").alias("r")).select("id", "r.*")


def ancestors(index: DataFrame) -> DataFrame:
    """``id, path, cyclic``: ids from the root down to each id of a unique (``id``, ``parent_id``) index.

    Each round joins a path with the path of its top, so paths double and a thread of depth d takes log2(d) rounds.
    An empty or unknown parent ends a path; a path that meets itself is cyclic and goes no further.
    """
    known = index.select(F.col("id").alias("pid"))
    step = index.join(known, F.col("parent_id") == F.col("pid"), "left")
    cur = written(step.select("id", F.array("id").alias("path"), F.col("pid").alias("up"), F.lit(False).alias("cyclic")), "paths")
    while not cur.where("up is not null and not cyclic").isEmpty():
        tops = cur.select(F.col("id").alias("tid"), F.col("path").alias("tpath"), F.col("up").alias("tup"), F.col("cyclic").alias("tcyc"))
        met = cur.join(tops, (F.col("up") == F.col("tid")) & ~F.col("cyclic"), "left")
        path = F.when(F.col("tid").isNotNull(), F.concat("tpath", "path")).otherwise(F.col("path"))
        nxt = met.select("id", path.alias("path"), F.when(F.col("tid").isNotNull(), F.col("tup")).otherwise(F.col("up")).alias("up"), F.coalesce(F.col("tcyc"), F.lit(False)).alias("tcyc"), "cyclic")
        loops = F.size(F.array_distinct("path")) < F.size("path")
        nxt = written(nxt.select("id", "path", "up", (F.col("cyclic") | F.col("tcyc") | loops).alias("cyclic")), "paths")
        forget(cur)
        cur = nxt
    return cur.select("id", "path", "cyclic")


def candidates(rows: DataFrame) -> DataFrame:
    """Rows that are training targets: an id and a non-blank answer."""
    return rows.where("id != '' and Assistentin != ''")


def chains(rows: DataFrame) -> DataFrame:
    """One row per target, with its way from the root: ``_rowidx, id, root, depth, path`` and ``chain``, in thread order.

    A target's own row is itself, even if a later row repeats its id; all rows above it are the last of their id.
    Targets on or below a cycle are left out (see ``cyclic_targets``). ``thread_first`` is the position of the
    thread's first target; sorting by it, depth and ``_rowidx`` gives thread order.
    """
    norm = normalise_rows(rows)
    index = last_by_id(norm)
    paths = ancestors(index)
    own = candidates(norm)
    # the way up starts at the row's own parent, which a repeated id may have changed
    up = paths.where("not cyclic").select(F.col("id").alias("aid"), F.col("path").alias("apath"))
    bad = paths.where("cyclic").select(F.col("id").alias("parent_id"))
    got = own.join(bad, "parent_id", "left_anti").join(up, F.col("parent_id") == F.col("aid"), "left")
    # thread and depth go by the last row of the id
    place = paths.where("not cyclic").select("id", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"))
    got = got.join(place, "id")
    # a row a thread; summed up before the shuffle, so that a thread of any size is no task of its own
    firsts = own.select("_rowidx", "id", "parent_id").join(bad, "parent_id", "left_anti").join(place.select("id", "root"), "id").groupBy("root").agg(F.min("_rowidx").alias("thread_first"))
    full = got.select("_rowidx", "id", "root", "depth", F.struct(*FIELDS).alias("own"), F.coalesce("apath", F.array().cast("array<string>")).alias("above"))
    named = index.select(F.col("id").alias("aid"), F.struct(*FIELDS).alias("row"))
    steps = full.select("_rowidx", F.posexplode("above").alias("pos", "aid")).join(named, "aid")
    rows_above = steps.groupBy("_rowidx").agg(F.sort_array(F.collect_list(F.struct("pos", "row"))).alias("s"))
    out = full.join(rows_above, "_rowidx", "left")
    empty = F.array().cast(out.select(F.array("own").alias("x")).schema["x"].dataType)
    out = out.select(
        "_rowidx", "id", "root", "depth", F.concat("above", F.array("id")).alias("path"),
        F.concat(F.coalesce(F.transform("s", lambda x: x["row"]), empty), F.array("own")).alias("chain"))
    return out.join(firsts, "root")


def cyclic_targets(rows: DataFrame) -> DataFrame:
    """Ids of targets that lie on or below a cycle of parents."""
    norm = normalise_rows(rows)
    return candidates(norm).join(ancestors(last_by_id(norm)).where("cyclic").select("id"), "id", "left_semi").select("id", "_rowidx")


def training_text(chain: str = "chain"):
    """Text of a chain for phrase mining: the root's system, then context, user and answer of each row, one a line."""
    parts = F.flatten(F.transform(chain, lambda r: F.array(r["Kontext"], r["Benutzer"], r["Assistentin"])))
    every = F.concat(F.array(F.element_at(chain, 1)["system"]), parts)
    return F.array_join(F.filter(every, lambda x: x != ""), "\n")
