"""Mixing sources to target weights by a splitting tree over blocks of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.llm.draws import even, splitting_tree
from tidewire.session import cut

# The mix is dealt in about so many blocks, whatever its size.
BLOCKS = 1 << 14
LEAST_BLOCK = 1 << 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` of all sizes dealt by weight; none above ``most`` times its size, the excess re-dealt."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else weights[i] * unit
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def deal_blocks(quota: list[int], shards: int, seed: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The block length in words, and (source number, block, shard, place) of every block.

    The splitting tree draws how many blocks of each source each shard gets; which ones they are
    follows from a permutation of each source's blocks, and their order from one of the shard's.
    """
    length = max(LEAST_BLOCK, -(-sum(quota) // BLOCKS))
    counts = [-(-q // length) for q in quota]
    rng = np.random.default_rng([seed, 7])
    by_shard = splitting_tree(rng, counts, even(sum(counts), shards))
    order = [rng.permutation(n) for n in counts]
    used, out = [0] * len(counts), []
    for s, row in enumerate(by_shard):
        mine = []
        for i, n in enumerate(row):
            mine += [(i, int(b)) for b in order[i][used[i] : used[i] + n]]
            used[i] += n
        out += [(*mine[k], s, place) for place, k in enumerate(rng.permutation(len(mine)).tolist())]
    return length, out


def mix(
    df: DataFrame,
    size: str,
    source: str,
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 16,
    seed: int = 20_240_131,
) -> DataFrame:
    """One row per piece that the mix takes, and one without a piece for each row it leaves out.

    Columns: those of ``df`` in the struct ``row``; ``rid`` (the row), ``size``, ``source_size``,
    ``target``; ``pass`` and ``take`` (the words taken in that pass), ``start`` and ``length`` (the
    piece's words), ``shard``, ``place`` (its block's in the shard), ``turn`` (its order in the
    block).  The words are null where the row is left out.

    Each source is permuted by a hash and read in passes as one stream of words until its target,
    rounded to a word, is reached; only the row at the end is cut.  The stream is dealt in blocks.
    Sources come in order of code points, null last, and are weighed by ``cycle`` in turn.  The
    sources and their weights are a list that the driver holds, as is the list of some 16,000 blocks.

    Null sizes count as 0; rows of size 0 are never taken.  Repeated rows are rows of their own.
    No rows give no rows.  The same rows and seed give the same result.
    """
    spark = df.sparkSession
    cells = C.cells_for(df.count())
    n, name = F.coalesce(C.col(size), F.lit(0)).cast("long"), C.col(source)
    sums = sorted(
        ((r[0], int(r[1] or 0)) for r in df.groupBy(name).agg(F.sum(n)).collect()),
        key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")),
    )
    words = [x for _, x in sums]
    aims = targets(words, [cycle[i % len(cycle)] for i in range(len(words))], share, most)
    quota = [min(round(t), int(most * w)) for t, w in zip(aims, words, strict=True)]
    length, blocks = deal_blocks(quota, shards, seed)
    kind = "source string, sid int, source_size long, target double, quota long"
    by_source = spark.createDataFrame(
        [(s, i, words[i], float(aims[i]), quota[i]) for i, (s, _) in enumerate(sums)], kind
    )
    rows = df.select(
        C.packed(df),
        n.alias("size"),
        name.alias("name"),
        F.pmod(C.row_key(df, seed), F.lit(cells)).alias("cell"),
        C.row_key(df, seed + 1).alias("k"),
    ).join(F.broadcast(by_source), F.col("name").eqNullSafe(F.col("source")))
    before = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("sid", "cell")
        .agg(F.sum("size").alias("n"))
        .select("sid", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    in_cell = Window.partitionBy("sid", "cell").orderBy("k", "size")
    upto = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passes = """filter(transform(sequence(0L, whole), p -> struct(
        p as pass, p * source_size + pos as off,
        if(p < whole, size, greatest(0L, least(size, rest - pos))) as take
    )), x -> x.take > 0)"""
    placed = (
        rows.select(
            "*",
            F.row_number().over(in_cell).alias("rank"),
            (F.sum("size").over(upto) - F.col("size")).alias("sofar"),
        )
        .join(starts, ["sid", "cell"])
        .withColumn("pos", F.col("first") + F.col("sofar"))
        .withColumn("whole", F.expr("coalesce(quota div nullif(source_size, 0), 0L)"))
        .withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
        .withColumn("one", F.explode_outer(F.expr(passes)))
        .select("*", "one.*")
        .withColumn(
            "block", F.explode_outer(F.expr(f"sequence(off div {length}, (off + take - 1) div {length})"))
        )
    )
    dealt = spark.createDataFrame(blocks, "sid int, block long, shard int, place int")
    begin = F.greatest(F.col("block") * length, F.col("off"))
    end = F.least((F.col("block") + 1) * length, F.col("off") + F.col("take"))
    return placed.join(F.broadcast(dealt), ["sid", "block"], "left").select(
        "row",
        F.struct("sid", "cell", "rank").alias("rid"),
        "size",
        "source_size",
        "target",
        "pass",
        "take",
        (begin - F.col("off")).alias("start"),
        (end - begin).alias("length"),
        "shard",
        "place",
        F.xxhash64(F.lit(seed + 2), "sid", "cell", "rank", "pass").alias("turn"),
    )


def taken(pieces: DataFrame, columns: list[str]) -> DataFrame:
    """One row per input row: the named columns of ``row``, its size, target and the words taken, and in
    ``places`` where the tree has put them: the shard, the block's place in it, the piece's turn in the
    block, and the piece's words; a row that is left out has none."""
    piece = F.when(F.col("length").isNotNull(), F.struct("shard", "place", "turn", "pass", "start", "length"))
    return (
        pieces.groupBy("rid.sid", "rid.cell", "rid.rank")
        .agg(
            *[F.first(F.col("row").getField(c)).alias(c) for c in columns],
            *[F.first(c).alias(c) for c in ("size", "source_size", "target")],
            F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("taken"),
            F.array_sort(F.collect_list(piece)).alias("places"),
        )
        .drop("sid", "cell", "rank")
    )


def realised(pieces: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The rows of the mix: one per pass that takes words of a row, its text cut to these words."""
    words = F.split(F.regexp_replace(F.col("row").getField(text), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int")), " ")
    whole = F.col("row").getField(text)
    return pieces.where("start = 0").select(
        *[
            F.when(F.col("take") < F.col("size"), cut_text).otherwise(whole).alias(c)
            if c == text
            else F.col("row").getField(c).alias(c)
            for c in columns
        ]
    )


def laid_out(pieces: DataFrame) -> DataFrame:
    """The pieces that are taken, each shard's in its order: by block, and shuffled in the block."""
    kept = pieces.where("length is not null")
    return kept.repartition("shard", "place").sortWithinPartitions("shard", "place", "turn")
