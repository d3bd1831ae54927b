"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut_counted

# A part of a hot key holds this many rows, or a millionth of all if that is more;
# so there are never more than a million hot keys and their list can be broadcast.
HOT_SHARE = 1_000_000
HOT_FLOOR = 100_000
# A list of so many ids at most is sent to every executor, some 100 MB.
LISTED = 4_000_000


def hot_keys(big: DataFrame, keys: list[str], total: int, floor: int | None = None) -> DataFrame | None:
    """Keys to split and into how many parts; None when no key can be hot."""
    floor = HOT_FLOOR if floor is None else floor
    if total <= floor:
        return None
    size = max(total // HOT_SHARE, floor)
    return (
        big.groupBy(*keys)
        .count()
        .where(F.col("count") > size)
        .select(*keys, F.ceil(F.col("count") / size).cast("int").alias("_parts"))
    )


def listed(ids: DataFrame, most: int) -> DataFrame:
    """A narrow table of ``most`` rows at most, which a join is to broadcast if that is no long list.

    So the other side, whose rows may be wide, isn't shuffled.
    """
    return F.broadcast(ids) if most <= LISTED else ids


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str,
    by: str,
    total: int,
    floor: int | None = None,
) -> DataFrame:
    """Join in which hot keys of ``big`` are split by ``by`` and ``small`` is copied per part.

    Cold keys take the ordinary join.  The result is that of the plain join.
    """
    hot = hot_keys(big, keys, total, floor)
    if hot is None:
        return big.join(small, keys, how)
    # Where no key is hot, what is already dealt by key isn't dealt again.
    hot, n = cut_counted(hot, "hot")
    if not n["rows"]:
        return big.join(small, keys, how)
    hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = big.join(hot, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(by), parts).cast("int")
    )
    right = small.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [*keys, "_part"], how).drop("_part")
