"""Steps that must not grow faster than their input."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_nearest import all_nearest, all_pairs, frame, unit, vectors
from tidewire.functions import vectors as V
from tidewire.operators import exact as X
from tidewire.operators import nearest as N
from tidewire.operators import similar as S
from tidewire.operators.embedders import DenseEmbedder
from tidewire.plans import dedup as D
from tidewire.plans.state import State
from tidewire.registry import base, flows, stores
from tidewire.registry.base import NOW


def test_copies_are_compared_once():
    """Of many equal rows only as many are looked at as a query can find."""
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(40, 8)))[rng.integers(0, 40, 4000)]
    q, barred = x[:100], np.arange(100)
    i, j, sim, looked = N.nearest(q, x, 3, np.full(100, -np.inf), barred, 64)
    assert looked <= 100 * 40 * 4
    assert [(a, b) for a, b, _ in all_nearest(q, x, 3, -np.inf, True)] == list(zip(i.tolist(), j.tolist()))


def test_pairs_come_in_parts():
    x = vectors("spread", 600)
    parts = list(N.similar_parts(x, x, -1.0, 50, 100))
    assert len(parts) == 6 and max(len(p[0]) for p in parts) <= 100 * 600
    assert {(a, b) for p in parts for a, b in zip(p[0].tolist(), p[1].tolist())} == all_pairs(x, x, -1.0)


def _refuse(*_, **__):
    raise AssertionError("all pairs above the threshold are formed")


@pytest.mark.parametrize("mode", ["first", "after_topk"])
def test_check_keeps_the_best_alone(spark, mode, monkeypatch):
    """A check asks for the best of each text, not for all that reach the threshold."""
    monkeypatch.setattr(N, "threshold_join", _refuse)
    x = vectors("clusters", 200)
    rows = frame(spark, x).select(F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.col("vec"), F.col("id").alias("n"))
    store = rows.select(
        "id", F.to_json("vec").alias("content"), V.unit(F.col("vec")).alias("vec"),
        F.expr(f"cast(array() as array<{V.KEY_TYPE}>)").alias("keys"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
        F.when(F.col("n") % 2 == 0, F.lit(NOW)).otherwise(F.lit(NOW - timedelta(hours=30))).alias("last_update"),
        F.lit("given").alias("model_name"),
    )
    none = F.lit(None).cast("string")
    asked = rows.select(
        F.col("n").alias("seq"), "id", F.lit("").alias("title"), F.lit("").alias("summary"), none.alias("full_content"),
        F.to_json("vec").alias("full_content_text"),
    )
    state = State(store, State.empty(spark).seen, NOW)
    dense = DenseEmbedder(0.2, lambda t: F.from_json(t, "array<double>"))
    got = {r["seq"]: r["matching_id"] for r in D.check(asked, state, NOW, dense, k=2, ttl_mode=mode).results.collect()}
    sims = np.round(x @ x.T, 6)
    for i, row in enumerate(sims):
        order = [j for j in np.lexsort((np.arange(200), -row)) if row[j] >= 0.2]
        order = order[:2] if mode == "after_topk" else order
        fresh = [j for j in order if j % 2 == 0]
        assert got[i] == (f"i{fresh[0]:04d}" if fresh else None)


def test_best_match_forms_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "threshold_join", _refuse)
    assert stores.agg3(spark, "/root/testdata/sf0.001").count() > 0


def _keep_first(rows):
    held, kept = [set(), set()], set()
    for seq, url, title in sorted(rows):
        if url not in held[0] and title not in held[1]:
            held[0].add(url)
            held[1].add(title)
            kept.add(seq)
    return kept


@pytest.mark.parametrize("kind", ["chain", "chains with crowds"])
def test_long_chains_are_settled_whole(spark, kind, monkeypatch):
    """Chains longer than a task may walk take a few rounds, whatever their length."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(X, "components", _refuse)
    rows = [(n, f"u{(n + 1) // 2}", f"t{n // 2}") for n in range(600)]
    if kind != "chain":
        names = rng.permutation(4000)
        rows = sorted((int(names[n % 7 * 500 + n // 7]) if n % 50 == 0 else 10_000 + n, u, t) for n, u, t in rows)
        rows += [(20_000 + i, f"u{rng.integers(0, 300)}", f"t{rng.integers(0, 300)}") for i in range(300)]
    monkeypatch.setattr(X, "SLOW", 0.0)
    articles = spark.createDataFrame(rows, "seq long, url string, title string")
    got = {r["seq"] for r in X.exact_keep_first(articles, rounds=8, walk=40).collect()}
    assert got == _keep_first(rows)


def test_messages_land_in_bounded_files(spark, monkeypatch):
    """No file and no partition of messages grows with their number; the batches stay four."""
    monkeypatch.setattr(flows, "MESSAGE_ROWS", 20)
    monkeypatch.setattr(base, "MESSAGE_ROWS", 20)
    folder = "/root/testdata/sf0.001"
    total = base.table(spark, folder, "events").count()
    path, each = flows._landed_messages(spark, folder)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == total and max(r["count"] for r in sizes) <= 40
    assert -(-len(sizes) // each) <= 4
    made = base.message_values(spark, folder)
    assert made.rdd.getNumPartitions() == -(-total // 20)


def test_few_texts_are_searched_without_a_shuffle(spark):
    """Few texts against many give the pairs of the general join, and the many stay where they are."""
    words = np.random.default_rng(2).integers(0, 30, (240, 12))
    rows = [(n, " ".join(f"w{w}" for w in row) + (" common words" if n % 2 else "")) for n, row in enumerate(words)] + [(500, ""), (501, None)]
    texts = V.with_terms(spark.createDataFrame(rows, "id long, text string").repartition(4), "text").drop("text").cache()
    vecs = V.embed(texts, V.fit(texts), 0.5).cache()
    few = vecs.where("id < 40 or id >= 500")
    beside = S.similar_pairs(few, vecs, 0.5)
    assert "Exchange" not in beside._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    want = {(r["lid"], r["rid"]): r["sim"] for r in S.similar_pairs(few, vecs, 0.5, crowded=20, few=-1).collect()}
    got = {(r["lid"], r["rid"]): r["sim"] for r in beside.collect()}
    assert got.keys() == want.keys() and len(got) > 40
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
