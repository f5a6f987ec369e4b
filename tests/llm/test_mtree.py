"""Top-k by the M-tree against brute force, and what its bounds leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmgraph.llm import mtree

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50):
    whole = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for at, (q, v) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for n, (i, w) in enumerate(whole) if n != at)[:k]
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored, 1)]
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA, **sizes):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect()), key=str)


def test_small_pages_of_clusters_copies_and_other_norms(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=8) * 0.05).tolist()) for i in range(900)]
    rows += [(i, centres[0].tolist()) for i in range(900, 1200)]  # a third are one vector
    rows += [(1200 + i, rng.normal(size=8).tolist()) for i in range(200)]
    random.Random(1).shuffle(rows)
    assert got(spark, rows, page=16, fan=12, block=8) == brute(rows)


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (100, []), (-50, [-1.0, -0.001]), (7, [0.0, 0.0])]
    padded = [(i, v if v is None else v + [0.0] * (2 - len(v))) for i, v in rows]
    assert got(spark, rows) == brute(padded)
    assert got(spark, [(0, [1.0])]) == [] and got(spark, [(None, [1.0]), (1, [1.0])]) == [] and got(spark, [(0, None)]) == []
    assert spark.createDataFrame([], SCHEMA).transform(lambda d: mtree.top_k(d, F.col("vec_id") % 50 == 0)).collect() == []
    df = spark.createDataFrame([(0, [1.0], 1, "a"), (1, [2.0], 2, "b")], "vec_id long, embedding array<double>, rank int, score string")
    assert [tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 131072)]


def test_large_components_are_exact(spark):
    rows = [(i, [float((i * 7919) % 4001 - 2000) * 97.0, float((i * 104729) % 3001 - 1500) * 89.0]) for i in range(300)]
    assert got(spark, rows, page=16, fan=8) == brute(rows)


@pytest.mark.parametrize("top", [1 << 40, 1 << 60])
def test_bounds_hold_and_leave_out(top):
    rng = np.random.default_rng(2)
    centre = rng.integers(-2000, 2000, 6)
    x = centre + rng.integers(-40, 40, (200, 6))
    q = np.concatenate([rng.integers(-4000, 4000, (30, 6)), x[:10]])
    top = max(int(mtree.squares(x).max()), 1) if top == 1 << 40 else top
    dist = mtree.distances(mtree.products(x, centre[None, :], True), mtree.squares(x), mtree.squares(centre[None, :]), top)[:, 0]
    to_node = np.sqrt(mtree.squares(q) + top - 2.0 * (q @ centre))
    dots = q @ x.T
    last = np.sort(dots, axis=1)[:, -5].astype(float)
    active, computed, _, (bounds, _) = mtree.visit(q, last, np.full(len(q), np.inf), to_node, x, dist, np.zeros(len(x)), top)
    assert len(active) == len(q) and (bounds >= dots[:, computed]).all()
    missing = np.setdiff1d(np.arange(len(x)), computed)
    assert (dots[:, missing] < last[:, None]).all()


def test_stored_distances_spare_computations():
    x = np.array([[1000 + i, 0] for i in range(0, 400, 10)])
    top = int(mtree.squares(x).max())
    p = x[:1]
    dist = mtree.distances(mtree.products(x, p, True), mtree.squares(x), mtree.squares(p), top)[:, 0]
    q = np.array([[1400, 0]])
    to_node = np.sqrt(mtree.squares(q) + top - 2.0 * (q @ p[0]))
    last = np.array([1390.0 * 1380])
    _, computed, _, _ = mtree.visit(q, last, np.array([np.inf]), to_node, x, dist, np.zeros(len(x)), top)
    assert 0 < len(computed) < len(x) and set(np.flatnonzero((q @ x.T)[0] >= last[0])) <= set(computed)
