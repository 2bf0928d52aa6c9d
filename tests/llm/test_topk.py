"""Inner-product search against brute force in unbounded integers."""

import math
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import topk_search


def brute(rows, k=20):
    ok = [(u, i, [math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x) for x in v]) for u, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for u, q, x in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for w, i, y in ok if w != u)[:k]
            out.update((q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    return Counter(tuple(r) for r in topk_search.top_k(df, **kw).collect())


@pytest.mark.parametrize("kw", [{"shard_rows": 64, "query_bytes": 8 * 64 * 3}, {}])
def test_every_row_counts(spark, kw):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(40, rows[40][1]), (40, [9.0] * 8), (3, [9.0] * 8), (3, [9.0] * 8)]  # repeated ids, as queries and as candidates
    rows += [(1000, None), (1020, [1.0, None] * 4), (1040, [float("nan")] * 8), (1041, [float("inf")] * 8), (None, [1.0] * 8), (1060, []), (1080, [1.0] * 3), (-20, [0.5] * 8)]
    assert run(spark, rows, **kw) == brute(rows)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(60)]
    rows += [(100, [1e15, -1e15, 1e15, 3.0]), (101, [1e15, 1.0, 1.0, 1.0]), (120, [2.0**70] * 4), (121, [-(2.0**70)] * 4), (140, [1.7e308, -1.7e308, 0.25, 0.0]), (141, [1.7e308, 1.7e308, 0.0, 1.0]), (142, [5e-324, 0.0, 0.0, -5e-324])]
    rows += [(160, [float(2**40), 1.0, 0.0, 0.0]), (161, [float(2**40), 1.0, 0.0, 0.0]), (162, [float(2**40), 1.015625, 0.0, 0.0])]  # differ in the last bits of large products
    assert run(spark, rows, wild_rows=3) == brute(rows)


def test_empty(spark):
    assert not run(spark, []) and not run(spark, [(20, [1.0])]) and not run(spark, [(1, [1.0]), (2, [1.0])]) and not run(spark, [(None, None)])
    assert run(spark, [(20, [1.0]), (1, [2.0])]) == Counter({(20, 1, 1, 64 * 128): 1})


def test_branches_fall_where_rows_lie_in_clusters():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 64, (40, 32))
    x = np.floor(centres[rng.integers(0, 40, 8192)] + rng.normal(0, 4, (8192, 32)))
    ids = np.arange(8192)
    tree = topk_search.BallTree(x, ids, ids)
    scores, found = topk_search.search_trees([tree], x[:200], ids[:200], 20, np.full(200, -np.inf))
    exact = x[:200] @ x.T
    exact[np.arange(200), np.arange(200)] = -np.inf
    best = np.lexsort((np.broadcast_to(ids, exact.shape), -exact), axis=1)[:, :20]
    assert (found == best).all() and (scores == np.take_along_axis(exact, best, 1)).all()
    assert tree.computed < 0.25 * 200 * 8192  # of all products


def test_kth_scores_go_on_from_tree_to_tree(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 64, (32, 32))
    x = np.floor(np.repeat(centres, 256, axis=0) + rng.normal(0, 4, (8192, 32)))
    ids, q = np.arange(8192), x[::100]
    grow = lambda: [topk_search.BallTree(x[a : a + 256], ids[a : a + 256], ids[a : a + 256]) for a in range(0, 8192, 256)]
    alone, together, bars = grow(), grow(), np.full(len(q), -np.inf)
    for tree in alone:
        topk_search.search_trees([tree], q, ids[::100], 20, bars)
    scores, found = topk_search.search_trees(together, q, ids[::100], 20, bars)
    exact = q @ x.T
    exact[np.arange(len(q)), ids[::100]] = -np.inf
    best = np.lexsort((np.broadcast_to(ids, exact.shape), -exact), axis=1)[:, :20]
    assert (found == best).all() and (scores == np.take_along_axis(exact, best, 1)).all()
    assert sum(t.computed for t in together) < 0.5 * sum(t.computed for t in alone)

    class Shared:
        value = ids[::100], ids[::100], q, bars

    blobs = [topk_search.pa.record_batch([topk_search.pa.array([topk_search.pickle.dumps(t)])], ["tree"]) for t in grow()]
    assert sum(b.num_rows for b in topk_search._searcher(Shared, 20)(iter(blobs))) == 20 * len(q)  # rows of a task, whatever its trees
