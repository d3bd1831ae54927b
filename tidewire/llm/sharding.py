"""Uniform shuffle into shards of exact size by a drawn communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.llm.draws import even, splitting_tree
from tidewire.session import cut


def communication_matrix(counts: DataFrame, sizes: list[int], blocks: int, seed: int) -> DataFrame:
    """How many rows each block sends to each shard: (block, upto), ``upto`` summed over the shards.

    A uniform shuffle's matrix has the multivariate hypergeometric law.  It is drawn in two steps:
    for groups of blocks (about the root of their number) in the driver, for the blocks of each
    group in a task.
    """
    spark = counts.sparkSession
    span = max(1, math.isqrt(blocks))
    grouped = counts.withColumn("grp", F.floor(F.col("block") / span).cast("long"))
    totals = sorted(map(tuple, grouped.groupBy("grp").agg(F.sum("n")).collect()))
    drawn = splitting_tree(np.random.default_rng([seed, 0]), [n for _, n in totals], sizes)
    quotas = [(g, [int(shard[i]) for shard in drawn]) for i, (g, _) in enumerate(totals)]

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        rng = np.random.default_rng([seed, 1, int(key[0])])
        shards = splitting_tree(rng, rows["n"].tolist(), [int(x) for x in rows["quotas"].iloc[0]])
        upto = np.cumsum(np.array(shards, dtype=np.int64), axis=0).T
        return pd.DataFrame({"block": rows["block"].to_numpy(), "upto": list(upto)})

    of = spark.createDataFrame(quotas, "grp long, quotas array<long>")
    return grouped.join(of, "grp").groupBy("grp").applyInPandas(draw, "block long, upto array<long>")


def shard(df: DataFrame, shards: int = 16, seed: int = 20_240_131) -> DataFrame:
    """Every row of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Law ``rows``: the shards' counts are at most one apart, and every arrangement is equally likely.
    Rows are dealt to blocks by a hash of all their columns, permuted in the block by a second hash,
    cut up by the drawn counts, and permuted again in their shard by a third hash.  Shards are
    ordered in many cells at once, so neither a block nor a shard is one task's work.

    Nulls, empty and long texts and repeated rows are rows like others; rows equal in every column
    are interchangeable, and so is their order.  No rows give no rows.  Columns of ``df`` named
    ``shard`` or ``slot`` are replaced.  The same rows, shards and seed give the same result.
    """
    names = df.columns
    rows = df.count()
    blocks = C.cells_for(rows)
    keyed = df.select(
        C.packed(df),
        F.pmod(C.row_key(df, seed), F.lit(blocks)).alias("block"),
        C.row_key(df, seed + 1).alias("k1"),
        C.row_key(df, seed + 2).alias("k2"),
    )
    counts = cut(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "shard-blocks")
    matrix = communication_matrix(counts, even(rows, shards), blocks, seed)
    in_block = Window.partitionBy("block").orderBy("k1", "k2")
    bits = max(6, (blocks // shards).bit_length())
    placed = cut(
        keyed.withColumn("rank", F.row_number().over(in_block) - 1)
        .join(matrix, "block")
        .select(
            "row",
            F.expr("size(filter(upto, x -> x <= rank))").alias("shard"),
            F.shiftrightunsigned("k2", 64 - bits).alias("cell"),
            "k1",
            "k2",
        ),
        "shard-placed",
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    in_cell = Window.partitionBy("shard", "cell").orderBy("k2", "k1")
    return (
        placed.withColumn("rank", F.row_number().over(in_cell) - 1)
        .join(starts, ["shard", "cell"])
        .select(
            *C.unpacked(placed, names, ["shard", "slot"]),
            F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("rank")).cast("long").alias("slot"),
        )
    )
