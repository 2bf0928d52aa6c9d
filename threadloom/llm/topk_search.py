"""Exact inner-product search by ball trees, one per shard, with branch and bound."""

from __future__ import annotations

import pickle
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm._store import forget, written

_LEAF = 64
_NONE = np.int64(-(2**62))
_NOBODY = np.int64(2**63 - 1)
#: Vectors of a shorter length than this have sums of products below 2**52, which floats add up exactly.
_TAME = 2.0**26
_DIGITS = 10**38 - 1
_FOUND = "query_uid long, query_id long, vec_id long, score decimal(38,0), beyond string"


class BallTree:
    """A ball tree over integer vectors (as floats): centre, radius, span of rows and children of each node.

    Nodes are halved along the direction between two far points, down to leaves of 64 rows. ``search`` bounds the inner
    product of a query with anything in a node by ``q . centre + |q| * radius``, lets whole branches fall that can't reach the
    query's current kth score, and takes each query's leaves in the order of its own bounds.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        order, spans, kids, todo = np.arange(len(ids)), [(0, len(ids))], [(-1, -1)], [0]
        while todo:
            node = todo.pop()
            a, b = spans[node]
            if b - a <= _LEAF:
                continue
            own = vectors[order[a:b]]
            far = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
            away = own[((own - far) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (away - far), half)]
            kids[node] = (len(spans), len(spans) + 1)
            todo += kids[node]
            spans += [(a, a + half), (a + half, b)]
            kids += [(-1, -1), (-1, -1)]
        self.vectors, self.ids, self.uids = vectors[order], ids[order], uids[order]
        self.spans, self.kids = np.array(spans), np.array(kids)
        self.centre = np.array([self.vectors[a:b].mean(axis=0) for a, b in spans])
        self.radius = np.array([np.sqrt(((self.vectors[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans, self.centre, strict=True)])
        self.reach = np.sqrt((self.centre**2).sum(axis=1)) + self.radius
        self.computed = 0

    def search(self, q: np.ndarray, uids: np.ndarray, bars: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        """Merges what this tree adds to each query's best (``scores``, ``found``: best first, ties to the smaller id).

        The two arrays hold what the trees before gave, so their kth scores bound this tree too; ``bars`` are scores that a
        row has to reach anyway. A query's own row is left out.
        """
        norm = np.sqrt((q * q).sum(axis=1))
        bound = q @ self.centre.T + norm[:, None] * (self.radius + 1e-9 * self.reach) + 1e-6
        alive = bound >= np.maximum(scores[:, -1], bars)[:, None]
        for node, (left, right) in enumerate(self.kids):  # parents come before children
            if left >= 0:
                alive[:, left] &= alive[:, node]
                alive[:, right] &= alive[:, node]
        leaves = np.flatnonzero(self.kids[:, 0] < 0)
        bound = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        at, width = 0, 1
        while at < len(leaves):
            kth = np.maximum(scores[:, -1], bars)
            go = bound[:, at : at + width] >= kth[:, None]
            if not go.any():
                break  # bounds fall from left to right, so nothing further on reaches a query either
            row, place = np.nonzero(go)
            leaf = order[row, at + place]
            by = np.argsort(leaf, kind="stable")
            row, leaf = row[by], leaf[by]
            cut = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
            parts = []
            for x, y in zip(cut, cut[1:], strict=False):
                a, b = self.spans[leaves[leaf[x]]]
                mine = row[x:y]
                got = q[mine] @ self.vectors[a:b].T
                self.computed += got.size
                i, j = np.nonzero((got >= kth[mine, None]) & (self.uids[None, a:b] != uids[mine, None]))
                parts.append((mine[i], np.rint(got[i, j]).astype(np.int64), self.ids[a + j]))
            self._merge(scores, found, *(np.concatenate(c) for c in zip(*parts, strict=True)))
            at, width = at + width, 2 * width

    @staticmethod
    def _merge(scores: np.ndarray, found: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = scores.shape[1]
        touched, row = np.unique(row, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), k), row])
        score, ids = np.concatenate([scores[touched].ravel(), score]), np.concatenate([found[touched].ravel(), ids])
        by = np.lexsort((ids, -score, row))
        row, score, ids = row[by], score[by], ids[by]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        scores[touched], found[touched] = score[best].reshape(-1, k), ids[best].reshape(-1, k)


def _quantise(scale: float):
    """Arrow function: components as ``floor(scale * x)``, which is a float itself; vectors of null or non-finite components go.

    ``wild`` marks vectors whose products floats can't hold exactly. ``code`` has the signs of sixteen fixed projections, so
    that rows in its order lie near each other.
    """
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            ids, out, wild, code = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                y = np.floor(scale * np.where(np.abs(x) < 2.0**900, x, 0)) if len(x) else x
                big = bool(np.abs(x).max(initial=0) >= 2.0**900) or float(np.sqrt((y * y).sum())) >= _TAME
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(16).normal(size=(16, len(x)))
                ids.append(i)
                wild.append(big)
                out.append((x if big else y).astype("<f8").tobytes())
                code.append(0 if big else int((planes[len(x)] @ y > 0) @ (1 << np.arange(16))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(wild, pa.bool_()), pa.array(code, pa.int32())], ["vec_id", "x", "wild", "code"])
    return run


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of packed vectors; shorter ones are filled up with zeros, which add nothing to a product."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = np.frombuffer(r, "<f8")
        out[i, : len(v)] = v
    return out


def _planter(shard_rows: int, width: int):
    """Arrow function: a tree for each ``shard_rows`` rows of a partition, the last ones fewer."""

    def tree(held):
        ids, uids, x = (sum((p[i] for p in held), []) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(BallTree(_matrix(x, width), np.array(ids, np.int64), np.array(uids, np.int64)), 5)], pa.binary())], ["tree"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, shard_rows - n)
                held.append(tuple(part.column(c).to_pylist() for c in ("vec_id", "uid", "x")))
                at, n = at + part.num_rows, n + part.num_rows
                if n == shard_rows:
                    yield tree(held)
                    held, n = [], 0
        if held:
            yield tree(held)
    return run


def search_trees(trees, q: np.ndarray, uids: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (scores, ids) of each query over all ``trees``; the kth score found so far goes on from tree to tree."""
    scores, found = np.full((len(q), k), _NONE), np.full((len(q), k), _NOBODY)
    for tree in trees:
        for a in range(0, len(q), 1024):
            part = slice(a, a + 1024)
            tree.search(q[part], uids[part], bars[part], scores[part], found[part])
    return scores, found


def _searcher(shared, k: int):
    """Arrow function: a task's trees one after the other, then at most ``k`` rows a query for all of them."""

    def run(batches):
        uids, ids, q, bars = shared.value
        scores, found = search_trees((pickle.loads(blob) for batch in batches for blob in batch.column("tree").to_pylist()), q, uids, k, bars)
        for a in range(0, len(q), 1024):
            part = found[a : a + 1024]
            row, _ = np.nonzero(part != _NOBODY)
            if len(row):
                yield _rows(uids[a + row], ids[a + row], part[part != _NOBODY], scores[a : a + 1024][part != _NOBODY].tolist())
    return run


def _rows(uids, ids, found, scores: list[int]) -> pa.RecordBatch:
    """Results; what 38 digits don't hold stands in ``beyond`` so that text order is the order of numbers."""
    cut = [Decimal(max(-_DIGITS, min(_DIGITS, s))) for s in scores]
    beyond = ["" if abs(s) < _DIGITS else _sortable(s) for s in scores]
    return pa.RecordBatch.from_arrays(
        [pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(cut, pa.decimal128(38, 0)), pa.array(beyond)], ["query_uid", "query_id", "vec_id", "score", "beyond"])


def _sortable(s: int) -> str:
    text = f"{abs(s):x}"
    text = f"{len(text):06x}{text}"
    return text if s > 0 else "".join("0123456789abcdef"[15 - int(c, 16)] for c in text) + "g"  # of negative numbers the larger is the less


def _integers(x: bytes, wild: bool, scale: float) -> list[int]:
    """Components of a packed row as unbounded integers."""
    v = np.frombuffer(x, "<f8").tolist()
    return [int(c * scale // 1) if abs(c) < 2.0**900 else int(c) * int(scale) for c in v] if wild else [int(c) for c in v]


def _exactly(shared, k: int, modulus: int, scale: float):
    """Arrow function: every row against a block of wild rows, as query and as candidate, in unbounded integers; the ``k`` best of each query."""

    def run(batches):
        block = [(u, i, _integers(x, True, scale)) for u, i, x in shared.value]
        for batch in batches:
            rows = [(u, i, _integers(x, w, scale), w) for u, i, x, w in zip(*(batch.column(c).to_pylist() for c in ("uid", "vec_id", "x", "wild")), strict=True)]
            best: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for u, i, v, w in rows:
                for bu, bi, bv in block:
                    if u != bu:
                        s = sum(a * b for a, b in zip(v, bv, strict=False))
                        if i % modulus == 0:
                            best.setdefault((u, i), []).append((-s, bi))
                        if bi % modulus == 0 and not w:  # a wild row meets the block's as a query itself
                            best.setdefault((bu, bi), []).append((-s, i))
            out = [(q, i, s) for q, found in best.items() for s, i in sorted(found)[:k]]
            yield _rows([q[0] for q, _, _ in out], [q[1] for q, _, _ in out], [i for _, i, _ in out], [-s for _, _, s in out])
    return run


def _blocks(rows: DataFrame, n: int, most: int):
    """The rows in blocks of about ``most``, each gathered on the driver by itself."""
    parts = max(1, -(-n // most))
    for b in range(parts):
        yield rows.where(F.pmod(F.xxhash64("uid"), F.lit(parts)) == b).toArrow()


def _best(found: DataFrame, k: int) -> tuple[DataFrame, Column]:
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, k: int = 20, query_modulus: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding",
    shard_rows: int = 4_096, query_bytes: int = 32 << 20, wild_rows: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query with all other rows.

    Vectors become ``floor(scale * x)``; rows whose id is divisible by ``query_modulus`` are the queries. Equal scores go to
    the smaller ``vec_id``. Every row is a row of its own: rows that share an id are candidates for each other, and as queries
    each has its own result. Rows with a null id or vector, or a null or non-finite component, take no part. Vectors of unlike length meet
    as if filled up with zeros, empty ones too. Products are exact, and so is their order, for any finite components; a score beyond
    64 bits is given as the nearest long. An empty table gives no row; other columns are ignored.

    Candidates in the order of a locality code are cut into shards of ``shard_rows`` rows; a shard's ball tree is built and written once,
    and no candidate moves again. The queries go to all trees in blocks of at most ``query_bytes`` with their results: first to an eighth
    of the shards, whose kth scores are the bars that branches of all others have to reach. Inside a task the kth score goes on from
    tree to tree, and the task gives at most ``k`` rows a query, however many trees it has. Rows whose products floats can't hold
    exactly meet all rows in unbounded integers, in blocks of ``wild_rows``.
    """
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"))
    x = written(x.mapInArrow(_quantise(scale), "vec_id long, x binary, wild boolean, code int").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    spark = x.sparkSession
    asks = F.pmod("vec_id", F.lit(query_modulus)) == 0
    size = x.agg(F.count_if(~F.col("wild")).alias("n"), F.count_if(~F.col("wild") & asks).alias("q"), F.count_if("wild").alias("w"), F.max(F.length("x")).alias("b")).first()
    width, parts = max(1, (size["b"] or 0) // 8), [spark.createDataFrame([], _FOUND)]
    if size["q"]:
        shards = -(-size["n"] // shard_rows)
        ranged = x.where(~F.col("wild")).repartitionByRange(shards, "code", "uid")
        trees = written(ranged.mapInArrow(_planter(shard_rows, width), "tree binary").withColumn("seed", F.spark_partition_id() % 8 == 0), "trees")
        for block in _blocks(x.where(~F.col("wild") & asks).select("uid", "vec_id", "x"), size["q"], max(1, query_bytes // (8 * (width + 2 * k)))):
            uids, ids = (block.column(c).to_numpy() for c in ("uid", "vec_id"))
            q, bars = _matrix(block.column("x").to_pylist(), width), np.full(len(uids), float(_NONE))
            for seed in (True, False):
                shared = spark.sparkContext.broadcast((uids, ids, q, bars))
                parts.append(written(_best(trees.where(F.col("seed") == seed).mapInArrow(_searcher(shared, k), _FOUND), k).drop("rank"), "found"))
                if seed:
                    kth = parts[-1].groupBy("query_uid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("m")).where(F.col("n") == k).toArrow()  # a row a query of the block
                    known = dict(zip(kth.column("query_uid").to_pylist(), kth.column("m").to_pylist(), strict=True))
                    bars = np.array([known.get(u, float(_NONE)) for u in uids.tolist()])
        forget(trees)
    if size["w"]:
        for block in _blocks(x.where("wild").select("uid", "vec_id", "x"), size["w"], wild_rows):
            shared = spark.sparkContext.broadcast(list(zip(*(block.column(c).to_pylist() for c in ("uid", "vec_id", "x")), strict=True)))
            parts.append(written(x.mapInArrow(_exactly(shared, k, query_modulus, scale), _FOUND), "found"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    score = F.least(F.greatest("score", F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return _best(found, k).select("query_id", "rank", "vec_id", score.alias("score"))
