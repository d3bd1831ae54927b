"""Connected components, and what is decided inside one of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut

# Components of at most so many narrow rows are walked through in one task.
WALK_ROWS = 1_000_000


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, component) per node that has an edge.

    ``component`` is the smallest id reachable.  Rounds of large-star and small-star: every node is
    tied to the smallest neighbour of its neighbourhood until the edges are stars.  Only minima are
    aggregated, no neighbour list is built, and each round is a written table.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    seen = None
    while True:
        now = e.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(
            tied.unionByName(least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v")
            .distinct(),
            name,
        )


def walked(rows: DataFrame, keys: list[str], limit: int = WALK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(judged, rest)`` of rows (seq, component, keys...): keep-first inside small components.

    ``judged`` is (seq, kept): in the order of ``seq``, a row is kept unless one of its keys is held
    by a kept row before it.  ``rest`` are the rows of components larger than ``limit``.
    """
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    sized = rows.join(sizes, "component")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        held: list[set] = [set() for _ in keys]
        kept = []
        for values in part[keys].itertuples(index=False, name=None):
            free = not any(v in h for v, h in zip(values, held, strict=True))
            if free:
                for v, h in zip(values, held, strict=True):
                    h.add(v)
            kept.append(free)
        return pd.DataFrame({"seq": part["seq"].to_numpy(), "kept": kept})

    small = sized.where(F.col("_n") <= limit).drop("_n")
    judged = small.groupBy("component").applyInPandas(walk, "seq long, kept boolean")
    return judged, sized.where(F.col("_n") > limit).drop("_n", "component")


def walked_edges(edges: DataFrame, limit: int = WALK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(judged, rest)`` of all conflicts (seq, earlier, component) of some rows.

    ``judged`` is (seq, kept) for both ends of every conflict: a row is kept unless one before it
    that conflicts with it is.  ``rest`` are the conflicts of components with more than ``limit``.
    """
    sizes = edges.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    sized = edges.join(sizes, "component")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "earlier"])
        kept: dict[int, bool] = {}
        before: dict[int, list[int]] = {}
        for seq, earlier in part[["seq", "earlier"]].itertuples(index=False, name=None):
            before.setdefault(seq, []).append(earlier)
            before.setdefault(earlier, [])
        for seq in sorted(before):
            kept[seq] = not any(kept[e] for e in before[seq])
        return pd.DataFrame({"seq": list(kept), "kept": list(kept.values())})

    small = sized.where(F.col("_n") <= limit).drop("_n")
    judged = small.groupBy("component").applyInPandas(walk, "seq long, kept boolean")
    return judged, sized.where(F.col("_n") > limit).drop("_n")
