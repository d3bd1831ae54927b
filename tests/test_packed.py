"""Bounds and tables that take less room, with the same results."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from tidewire.functions import vectors as V
from tidewire.operators import similar as S
from tidewire.session import cut


def test_bounds_travel_in_one_number_and_refuse_no_similar_pair(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(120)]
    texts += [t + " w1" for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counted = V.with_terms(df, "text").drop("text")
    rows = cut(V.embed(counted, V.fit(counted), 0.8), "v", packed=True)
    side = S._side(rows, "l", 0.8)
    assert dict(side.dtypes) == {"lid": "bigint", "key": "bigint", "lb": "int"}
    # The numbers are on the safe side of what they stand for, by two steps at most.
    plain = {(r["id"], k["k"]): k for r in rows.collect() for k in r["keys"]}
    for r in side.select("lid", "key", S._weight("lb").alias("w"), S._length("lb").alias("rest")).collect():
        k = plain[r["lid"], r["key"]]
        for got, real in ((r["w"], k["w"]), (r["rest"], min(1.0, 1 - k["c"] + k["w"] ** 2))):
            assert 0 <= got - real * S.SCALE < 2
    vecs = {r["id"]: dict(zip(r["vec"]["f"], r["vec"]["w"])) for r in rows.collect()}
    want = {(a, b) for a in vecs for b in vecs if sum(w * vecs[b].get(f, 0.0) for f, w in vecs[a].items()) >= 0.8}
    pairs = S.shared_keys(rows, rows, 0.8, 0, None)
    assert {(r["lid"], r["rid"]) for r in pairs.collect()} >= want
    # Keys that lie late in both rows form no pairs, and all keys of a pair refuse most that are left.
    every = rows.select(F.col("id").alias("lid"), F.explode("keys.k").alias("key"))
    every = every.join(every.withColumnRenamed("lid", "rid"), "key").select("lid", "rid").distinct().count()
    left = S.promising(pairs, rows, rows, 0.8)
    assert {(r["lid"], r["rid"]) for r in left.collect()} >= want
    assert left.count() < pairs.count() < 0.9 * every
    got = S.similar_pairs(rows, rows, 0.8, few=0)
    assert {(r["lid"], r["rid"]) for r in got.collect()} == want and len(want) > len(vecs)


def test_packed_tables_take_less_disk(spark):
    df = spark.range(20_000).select(F.md5((F.col("id") % 5000).cast("string")).alias("x"))
    sizes = [sum(Path(f.removeprefix("file:")).stat().st_size for f in cut(df, "size", p).inputFiles()) for p in (False, True)]
    assert sizes[1] < 0.8 * sizes[0]
    assert cut(df, "rows", True).exceptAll(df).isEmpty()
