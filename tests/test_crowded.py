"""Keys that stay crowded: compared by blocks, with the same result as one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import vectors as V
from tidewire.operators import similar as S
from tidewire.operators.greedy import keep_first
from tidewire.session import cut


@pytest.mark.parametrize("depth,step", [(2, 4), (3, 3)])
def test_crowded_keys(spark, depth, step):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9)]
    texts = [" ".join(rng.sample(words, 4)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, text string")
    counted = cut(V.with_terms(df, "text").drop("text"), "t")
    vecs = cut(V.embed(counted, V.fit(counted), 0.7), "v")
    rows = {r["seq"]: dict(zip(r["vec"]["f"], r["vec"]["w"])) for r in vecs.collect()}
    kept = []
    for i in sorted(rows):
        if all(sum(x * rows[j].get(f, 0.0) for f, x in rows[i].items()) < 0.7 for j in kept):
            kept.append(i)
    find = S.term_finder(vecs, 0.7, crowded_at=step, block=16)
    total = vecs.agg(F.sum(F.size("keys"))).first()[0]
    got = keep_first(
        vecs.select("seq", "keys"), find, F.size("keys"), total, first_depth=depth, max_depth=step
    )
    assert sorted(r[0] for r in got.collect()) == kept


def test_crowded_pairs_between_sides(spark):
    """With string ids on one side, as in the store; all pairs, none twice."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(8)]
    df = spark.createDataFrame(
        [(i, " ".join(rng.sample(words, 4))) for i in range(90)], "id long, text string")
    counted = cut(V.with_terms(df, "text").drop("text"), "t")
    left = cut(V.embed(counted, V.fit(counted), 0.7), "v")
    right = left.withColumn("id", F.concat(F.lit("s"), "id"))
    plain = S.similar_pairs(left, right, 0.7, 0)
    crowded = S.similar_pairs(left, right, 0.7, 0, crowded=5, block=16)
    show = lambda df: sorted((r["lid"], r["rid"], round(r["sim"], 9)) for r in df.collect())
    assert show(plain) == show(crowded) and len(show(plain)) > 90
