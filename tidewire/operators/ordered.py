"""Ordered lists of groups that may hold any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A list is cut into parts only beyond this size.
PART_BYTES = 64 << 20
# So many numbers of ``seq`` are gathered at once.
CELL_SPAN = 10_000


def ordered_parts(
    df: DataFrame,
    by: list[str],
    order: list[str],
    value: Column,
    out: str,
    part_bytes: int = PART_BYTES,
    span: int = CELL_SPAN,
) -> DataFrame:
    """``by, part, out``: a group's values in ``order``, one row per group unless it is very large.

    The last column of ``order`` is a whole number, unique beside the others.  Values are gathered
    by ranges of it; the sizes of the ranges, few and narrow, are summed up along the order, and a
    part ends where ``part_bytes`` are reached.  Parts in order are the whole list.
    """
    *major, seq = order
    pair = F.struct(F.col(seq).alias("s"), value.alias("v"))
    cells = (
        df.groupBy(
            F.struct(*by).alias("_by"),
            F.struct(*major, F.floor(F.col(seq) / span).cast("long").alias("_cell")).alias("_at"),
        )
        .agg(F.array_sort(F.collect_list(pair)).alias("_l"), F.sum(F.octet_length(value)).alias("_bytes"))
    )
    before = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("_bytes").over(before), F.lit(0))
    parts = cells.select("_by", "_at", F.floor(upto / part_bytes).cast("long").alias("part"))
    whole = F.array_sort(F.collect_list(F.struct("_at", F.col("_l")["v"].alias("v"))))
    return (
        cells.select("_by", "_at", "_l")
        .join(parts, ["_by", "_at"])
        .groupBy("_by", "part")
        .agg(whole.alias("_l"))
        .select("_by.*", "part", F.flatten(F.col("_l")["v"]).alias(out))
    )
