"""A Merkle manifest of grouped rows, whose proofs come from a butterfly exchange."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.session import cut

FANOUT = 3
# A partition is an aligned run of FANOUT to this power leaves of one tree.
HEIGHT = 7
# Leaves that are handed to one call, in whole partitions.
BUNDLE = 1 << 15
PROOF = "array<array<string>>"


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)), 256)


def joined(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that ``start`` and the siblings in ``proof`` lead to."""
    return F.aggregate(proof, start, lambda at, level: joined(F.transform(level, lambda x: F.coalesce(x, at))))


def siblings(proof: Column) -> Column:
    """The digests in ``proof`` from the leaves up, left to right, without the node's own places."""
    return F.filter(F.flatten(proof), lambda x: x.isNotNull())


def placed(leaves: DataFrame) -> DataFrame:
    """(tree, o, leaf, row) with ``pos``, gapless from 0 in each tree by ``o`` and ``leaf``, and the
    tree's ``n``.

    Rows are sorted in ranges of all trees at once, however large one of them is; rows equal in all
    that is sorted by are told apart by where they were read, so that they too are split up.
    """
    spark = leaves.sparkSession
    named = cut(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), named.count() // C.CELL_ROWS)
    order = [F.asc_nulls_first("o"), F.asc("leaf"), F.asc("tie")]
    ranged = named.repartitionByRange(cells, F.asc("tree"), *order)
    dealt = cut(ranged.withColumn("cell", F.spark_partition_id()), "merkle-ranges")
    counts = dealt.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree",
        "cell",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    in_cell = Window.partitionBy("tree", "cell").orderBy(*order)
    return (
        dealt.withColumn("rank", F.row_number().over(in_cell) - 1)
        .join(starts, ["tree", "cell"])
        .select("tree", (F.col("start") + F.col("rank")).alias("pos"), "n", "leaf", "row")
    )


def ladder(nodes: list[str], whole: bool, fanout: int, height: int) -> list[list[str]]:
    """All levels of a partition's subtree, leaves first; of a ``whole`` tree until one node remains."""
    levels = [nodes]
    while len(levels) <= height and not (whole and len(levels[-1]) == 1):
        below = levels[-1]
        runs = ("".join(below[i : i + fanout]) for i in range(0, len(below), fanout))
        levels.append([hashlib.sha256(run.encode()).hexdigest() for run in runs])
    return levels


def paths(levels: list[list[str]], fanout: int) -> pa.Array:
    """For every leaf, level by level, its run of nodes with a null in its own place."""
    count, steps = len(levels[0]), len(levels) - 1
    nodes = pa.array([d for level in levels for d in level], pa.string())
    first = np.cumsum([0] + [len(level) for level in levels])
    own = np.arange(count)[:, None] // fanout ** np.arange(steps)[None, :]
    run = own - own % fanout
    sizes = np.minimum(fanout, np.array([len(level) for level in levels[:-1]], dtype=np.int64)[None, :] - run)
    member = run[:, :, None] + np.arange(fanout)
    there = np.arange(fanout) < sizes[:, :, None]
    at = (member + first[:steps][None, :, None])[there]
    inner = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes.ravel())]), pa.int32()),
        nodes.take(pa.array(at, mask=(member == own[:, :, None])[there])),
    )
    return pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * steps, pa.int32()), inner)


def _runs(table: pa.Table) -> list[tuple[int, int]]:
    """Where the partitions of a sorted table begin and end."""
    if not table.num_rows:
        return []
    tree = table.column("tree").combine_chunks().dictionary_encode()
    tree = tree.combine_chunks() if isinstance(tree, pa.ChunkedArray) else tree
    key = np.stack([tree.indices.to_numpy(), table.column("part").to_numpy()])
    edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), table.num_rows], strict=True))


def butterfly(roots: DataFrame, most: int, fanout: int) -> DataFrame:
    """(tree, part, parts, digest) to (tree, part, digest, up): the tree's root and the path to it.

    In round r the partitions of a tree whose numbers differ in digit r alone swap the roots of
    their subtrees, and each of them hashes the parent for itself; so after the last round every
    partition holds the root and all siblings above it, and nothing is handed down.  A group has at
    most ``fanout`` senders.  Where the last subtree is short of partitions, those it has also send to
    the groups of the missing ones.
    """
    state, width = roots.withColumn("up", F.expr(f"cast(array() as {PROOF})")), 1
    while width < most:
        open_ = state.where(F.col("parts") > width)
        last = (F.floor((F.col("parts") - 1) / width) * width).cast("long")
        lane, digit = F.col("part") % width, F.floor(F.col("part") / width).cast("long") % fanout
        guests = (F.col("part") >= last) & (digit > 0)
        lanes = F.when(guests, F.sequence(lane, F.lit(width - 1).cast("long"), F.col("parts") - last)).otherwise(
            F.array(lane)
        )
        sent = open_.select(
            "tree",
            F.floor(F.col("part") / (width * fanout)).cast("long").alias("grp"),
            F.posexplode(lanes).alias("copy", "lane"),
            digit.alias("digit"),
            "digest",
            "part",
            "parts",
            "up",
        )
        member = F.struct(
            "digit",
            "digest",
            F.when(F.col("copy") == 0, F.struct("part", "parts", "up")).alias("own"),
        )
        groups = sent.groupBy("tree", "grp", "lane").agg(F.array_sort(F.collect_list(member), _by_digit).alias("m"))
        met = groups.select("tree", "m", F.explode("m").alias("me")).where("me.own is not null")
        level = F.transform("m", lambda x: F.when(x["digit"] != F.col("me.digit"), x["digest"]))
        raised = met.select(
            "tree",
            "me.own.part",
            "me.own.parts",
            joined(F.col("m.digest")).alias("digest"),
            F.concat("me.own.up", F.array(level)).alias("up"),
        )
        done = state.where(F.col("parts") <= width)
        state = cut(done.select(raised.columns).unionByName(raised), "merkle-round")
        width *= fanout
    return state.select("tree", "part", "digest", "up")


def _by_digit(x: Column, y: Column) -> Column:
    return (x["digit"] - y["digit"]).cast("int")


def trees(leaves: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> tuple[DataFrame, Callable]:
    """``(tops, below)`` of leaves (tree, o, leaf, row).

    ``tops`` (tree, part, digest, up) is what each partition knows after the exchange, and
    ``below(tops)`` joins it, with any other columns it has got, to (row, tree, leaf, digest, proof).
    """
    span = fanout**height
    part = F.floor(F.col("pos") / span).cast("long")
    rows = placed(leaves).withColumn("part", part)
    rows = cut(rows.withColumn("parts", F.ceil(F.col("n") / span).cast("long")), "merkle-placed")
    total, most = rows.agg(F.count(F.lit(1)), F.max("parts")).first()
    bundle = F.pmod(F.xxhash64("tree", "part"), F.lit(max(1, total // BUNDLE)))
    order = [("tree", "ascending"), ("part", "ascending"), ("pos", "ascending")]

    def rooted(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        runs = _runs(table)
        digests = table.column("leaf").to_pylist()
        parts = table.column("parts").to_pylist()
        tops = [ladder(digests[a:b], parts[a] == 1, fanout, height)[-1][0] for a, b in runs]
        heads = table.take(pa.array([a for a, _ in runs], pa.int64())).select(["tree", "part", "parts"])
        return heads.append_column("digest", pa.array(tops, pa.string()))

    narrow = rows.select("tree", "part", "parts", "pos", "leaf", bundle.alias("bundle"))
    roots = narrow.groupBy("bundle").applyInArrow(rooted, "tree string, part long, parts long, digest string")
    tops = butterfly(cut(roots, "merkle-roots"), most or 0, fanout)
    row_type = rows.schema["row"].dataType.simpleString()

    def proven(table: pa.Table, tops: pa.Table) -> pa.Table:
        table, tops = table.sort_by(order), tops.sort_by(order[:2])
        digests = table.column("leaf").to_pylist()
        parts = table.column("parts").to_pylist()
        runs = _runs(table)
        proofs = [paths(ladder(digests[a:b], parts[a] == 1, fanout, height), fanout) for a, b in runs]
        mine = pa.array(np.repeat(np.arange(len(runs)), [b - a for a, b in runs]), pa.int64())
        local = pa.chunked_array(proofs, pa.list_(pa.list_(pa.string())))
        out = table.select(["row", "tree", "leaf"]).append_column("local", local)
        for name in tops.column_names:
            if name not in ("tree", "part", "bundle"):
                out = out.append_column(name, tops.column(name).combine_chunks().take(mine))
        return out

    def below(tops: DataFrame) -> DataFrame:
        keyed = rows.withColumn("bundle", bundle).groupBy("bundle")
        own = [f for f in tops.schema if f.name not in ("tree", "part")]
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
        out = keyed.cogroup(tops.withColumn("bundle", bundle).groupBy("bundle")).applyInArrow(
            proven, f"row {row_type}, tree string, leaf string, local {PROOF}, {shape}"
        )
        return out.withColumn("proof", F.concat("local", "up")).drop("local", "up")

    return tops, below


def manifest(
    df: DataFrame, group: str, order: str, leaf: str, fanout: int = FANOUT, height: int = HEIGHT
) -> DataFrame:
    """Every row of ``df`` as ``row``, with ``leaf``, ``subroot``, ``root`` and ``proof``.

    The leaves of a ``group`` stand in the order of ``order``; while there are several nodes, every
    ``fanout`` consecutive ones, at the end fewer or one, become the digest of their joined hex
    texts.  What remains is the group's subroot, a lone leaf itself; the subroots, in the bytewise
    order of their groups, become the root in the same way.  ``proof`` has an array per level up to
    the root: the run that the node is in, with a null in its own place (see ``fold``).

    A null group is the first one; null orders come first in their group, equal ones stand in the
    order of their leaves, and rows with equal leaves are interchangeable.  No rows give no rows.
    The operator's columns are beside ``row``, so any column names are fine.  ``df`` is shuffled, so
    select the few columns that are wanted back; texts belong into the leaf alone.
    """
    name = F.coalesce(F.concat(F.lit("="), C.col(group).cast("string")), F.lit(""))
    leaves = df.select(name.alias("tree"), C.col(order).alias("o"), C.col(leaf).alias("leaf"), C.packed(df))
    tops, below = trees(leaves, fanout, height)
    subroots = tops.where("part = 0").select(
        F.lit("").alias("tree"),
        F.col("tree").alias("o"),
        F.col("digest").alias("leaf"),
        F.struct("tree").alias("row"),
    )
    over, above = trees(subroots, fanout, height)
    crowns = cut(
        above(over).select(F.col("row.tree").alias("tree"), F.col("digest").alias("root"), "proof"), "merkle-crowns"
    )
    whole = tops.join(crowns, "tree").select("tree", "part", "digest", "root", F.concat("up", "proof").alias("up"))
    return below(cut(whole, "merkle-tops")).select(
        "row", "leaf", F.col("digest").alias("subroot"), "root", "proof"
    )
