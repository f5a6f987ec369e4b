"""Whitening against numpy on whole matrices."""

import numpy as np
import pytest

from firmgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def run(spark, rows, **sizes):
    return [r.asDict() for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA), **sizes).collect()]


def whole(rows):
    clean = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in clean]), axis=0)
    n, sums = len(fit), fit.sum(0)
    v = ((fit - sums / n).T @ (fit - sums / n)) / n
    e, u = np.linalg.eigh(v)
    return clean, n, sums, v, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("dims, tile, block", [(7, 3, 11), (20, 32, 4096), (18, 6, 40)])
def test_equals_whole_matrices(spark, dims, tile, block):
    rng = np.random.default_rng(dims)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, dims)) @ rng.normal(size=(dims, dims)))]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    clean, n, sums, v, e, u = whole(rows)
    got = run(spark, rows, tile=tile, block=block)
    k = min(16, dims)
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-8
    by = {(r["vec_id"], r["component"]): r for r in got}
    sign = {c: np.sign(by[0, c]["whitened"] * ((clean[0][1] - sums / n) @ u[:, c - 1])) for c in range(1, k + 1)}
    for i, x in clean:
        for c in range(1, k + 1):
            r = by[i, c]
            assert r["deviation"] == sum(int(n * a - s) ** 2 for a, s in zip(x.tolist(), sums.tolist()))
            assert abs(r["explained"] / (e[c - 1] / np.trace(v)) - 1) < 1e-6
            assert abs(r["whitened"] - sign[c] * ((x - sums / n) @ u[:, c - 1]) / np.sqrt(e[c - 1])) < 1e-6


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0]), (4, None), (5, [nan, 0.0]), (6, [None, 0.0]), (7, [inf, 0.0]), (8, [1.0]), (9, [])]
    got = run(spark, rows)
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == [("1", 1), ("1", 1), ("1", 2), ("1", 2), ("None", 1), ("None", 2)] and {r["n"] for r in got} == {3}
    assert run(spark, []) == [] and run(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])]) == [] and run(spark, [(1, None)]) == []
    line = run(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])  # one component only
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    df = spark.createDataFrame([(1, [0.0, 1.0], 5, "x"), (2, [1.0, 0.5], 6, "y")], "vec_id int, embedding array<float>, n int, whitened string")
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 2


def test_very_long_vectors_go_in_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 300)))]
    got = run(spark, rows)
    assert len(got) == 640 and max(r["identity_error"] for r in got) < 1e-8
