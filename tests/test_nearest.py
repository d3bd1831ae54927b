"""Pruned joins of vectors against all pairs: in one task, and over levels of cells."""

import random

import numpy as np
import pytest

from tidewire.operators import nearest as N
from tidewire.operators import similar as S


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(kind, n=900, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "spread":
        return unit(rng.normal(size=(n, 12)))
    if kind == "clusters":
        return unit(rng.normal(size=(30, 32))[rng.integers(0, 30, n)] + 0.1 * rng.normal(size=(n, 32)))
    if kind == "copies":
        x = unit(rng.normal(size=(n, 6)))
        x[n // 3 :] = x[0]
        return x
    x = unit(rng.normal(size=(n, 5)).round(1) + 1e-3)
    x[:4] = 0.0
    return x


KINDS = ["spread", "clusters", "copies", "zeros and ties"]


def all_pairs(q, x, threshold):
    return {(i, j) for i, j in zip(*np.nonzero(q @ x.T >= threshold), strict=True)}


def all_nearest(q, x, k, floor, skip):
    sims = np.round(q @ x.T, 6)
    if skip:
        np.fill_diagonal(sims, -np.inf)
    out = []
    for i, row in enumerate(sims):
        order = np.lexsort((np.arange(len(x)), -row))[:k]
        out += [(i, int(j), row[j]) for j in order if row[j] > -np.inf and row[j] >= floor]
    return out


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("leaf", [7, 64, 10_000])
def test_one_task_finds_what_all_pairs_find(kind, leaf):
    x = vectors(kind, 400)
    q = x[:120]
    for threshold in (-0.2, 0.3, 0.9, 1.0 - 1e-9):
        i, j, sim, looked = N.similar(q, x, threshold, leaf)
        assert set(zip(i.tolist(), j.tolist())) == all_pairs(q, x, threshold) and looked <= q.shape[0] * len(x)
        assert np.allclose(sim, (q @ x.T)[i, j])
    for k in (1, 5, 500):
        for floor in (-np.inf, 0.5):
            i, j, sim, _ = N.nearest(q, x, k, np.full(len(q), floor), np.arange(len(q)), leaf)
            want = all_nearest(q, x, k, floor, True)
            assert [(a, b) for a, b, _ in want] == list(zip(i.tolist(), j.tolist()))


def test_far_leaves_are_not_looked_into():
    """Vectors in groups: a search looks at under a fifth of all pairs, without and with a threshold."""
    x = vectors("clusters", 20_000)
    q = x[:500]
    barred = np.arange(500)
    for floor in (-np.inf, 0.9):
        assert N.nearest(q, x, 5, np.full(500, floor), barred, 200)[3] < 0.2 * 500 * len(x)
    assert N.similar(q, x, 0.9, 200)[3] < 0.2 * 500 * len(x)


def frame(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(4).cache()


@pytest.mark.parametrize("kind", ["clusters", "copies", "zeros and ties"])
def test_levels_of_cells_find_what_all_pairs_find(spark, kind, monkeypatch):
    """Cells of 60 rows at most, so that there are several levels, and cells that can't be cut."""
    monkeypatch.setattr(N, "FANOUT", 4)
    x = vectors(kind, 320)
    df = frame(spark, x)
    n = len(x)
    cells = N.Cells(df, n, 60)
    sizes = {r["cell"]: r["count"] for r in cells.placed.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == n and len(cells.levels) >= (1 if kind == "copies" else 2)
    assert kind == "copies" or max(sizes.values()) <= 60
    found = N.threshold_join(df, df, 0.9, n, n, earlier_only=True, block=50, cell_rows=60).collect()
    want = {(i, j) for i, j in all_pairs(x, x, 0.9) if j < i}
    assert len(found) == len(want) and {(r["lid"], r["rid"]) for r in found} == want
    k, threshold = 3, 0.8 if kind == "copies" else None
    got = S.knn(df, df, k, n, n, threshold, skip_self=True, block=50, cell_rows=60).collect()
    flat = all_nearest(x, x, k, threshold or -np.inf, True)
    assert sorted((r["query_id"], r["id"]) for r in got) == sorted((i, j) for i, j, _ in flat)
    ranked = {(r["query_id"], r["rank"]): r["id"] for r in got}
    assert all(ranked[i, at] == j for i in {f[0] for f in flat} for at, (_, j, _) in enumerate((f for f in flat if f[0] == i), 1))


def test_queries_beside_another_store(spark):
    x, q = vectors("clusters", 700), vectors("spread", 40, 9)
    q = np.concatenate([unit(q @ np.random.default_rng(1).normal(size=(12, 32))), x[:20]])
    store, asking = frame(spark, x), frame(spark, q)
    got = S.knn(asking, store, 2, len(q), len(x), block=16, cell_rows=100).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == sorted((i, j) for i, j, _ in all_nearest(q, x, 2, -np.inf, False))
    pairs = N.threshold_join(asking, store, 0.95, len(q), len(x), block=16, cell_rows=100).collect()
    assert {(r["lid"], r["rid"]) for r in pairs} == all_pairs(q, x, 0.95) and pairs
    assert S.knn(asking.limit(0), store, 2, 0, len(x), cell_rows=100).count() == 0
    assert N.threshold_join(asking, store.limit(0), 0.5, len(q), 0).count() == 0


def test_only_visited_cells_get_a_row(spark):
    """Of vectors in groups a row goes to a few of the cells, not to all."""
    x = vectors("clusters", 3000)
    df = frame(spark, x)
    cells = N.Cells(df, len(x), 100, 16)
    from pyspark.sql import functions as F

    visits = cells.visits(df.withColumn("least", F.lit(0.9))).count()
    all_cells = cells.placed.select("cell").distinct().count()
    assert visits < 0.2 * len(x) * all_cells
