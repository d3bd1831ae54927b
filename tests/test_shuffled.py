"""What a dedup shuffles: no vectors but those that are in a pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import similar, spread
from tidewire.operators.greedy import keep_first


def _vectors(spark, n):
    vec = F.struct(F.array(F.col("id")).alias("f"), F.array(F.lit(1.0)).alias("w")).alias("vec")
    return spark.range(n).select("id", vec)


def test_only_paired_vectors_are_joined(spark, monkeypatch):
    monkeypatch.setattr(similar, "cut_counted", lambda df, name, **m: (df, {"rows": df.count()}))
    asked = []
    whole = similar.spread_join
    monkeypatch.setattr(similar, "spread_join", lambda big, small, *a: asked.append(small.count()) or whole(big, small, *a))
    rows = _vectors(spark, 50)
    pairs = spark.createDataFrame([(3, 3), (4, 3), (5, 5)], "lid long, rid long")
    got = similar.score_pairs(pairs, rows, rows, 0.5).collect()
    assert sorted((r["lid"], r["rid"], r["sim"]) for r in got) == [(3, 3, 1.0), (5, 5, 1.0)]
    assert asked == [2, 3]
    # Beyond the longest list the ids are shuffled, with the same rows.
    for module in (similar, spread):
        monkeypatch.setattr(module, "LISTED", 1)
    assert sorted(r["lid"] for r in similar.score_pairs(pairs, rows, rows, 0.5).collect()) == [3, 5]


def test_settled_rows_are_written_without_their_keys(spark, monkeypatch):
    from tidewire.operators import greedy

    written = []
    whole = greedy.cut_counted

    def watched(df, name, **metrics):
        out = whole(df, name, **metrics)
        written.append(out[0])
        return out

    monkeypatch.setattr(greedy, "cut_counted", watched)
    rows = spark.range(6).select(F.col("id").alias("seq"), F.array("id").alias("keys"))

    def find(live, depth, total):
        edges = live.where("seq = 1").select("seq", F.lit(0).cast("long").alias("earlier"))
        return edges, live.select("seq").where(F.lit(depth > 8) | (F.col("seq") < 5))

    kept = keep_first(rows, find, F.size("keys"), 6)
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert [sorted(r["seq"] for r in w.where("keys is not null").collect()) for w in written] == [[5], []]


def test_keys_are_dealt_again_only_where_one_is_hot(spark):
    big = spark.range(100).select(F.col("id").alias("row"), (F.col("id") % 5).alias("key"))
    small = spark.range(5).select(F.col("id").alias("key"), F.lit(7).alias("x"))
    for floor, salted in ((30, False), (10, True)):
        joined = spread.spread_join(big, small, ["key"], "inner", "row", 100, floor)
        assert joined.count() == 100
        assert ("_part" in joined._jdf.queryExecution().toString()) == salted
