"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import tune

# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Rows that one sorted cell or block holds on average.
CELL_ROWS = 1 << 17
# So many cells there are at least, so that no task gets a large share of a small table.
LEAST_CELLS = 1024
# A key with more than this share of the rows is hot; so there are fewer than 1,000 of them.
HOT_SHARE = 0.001
# A lookup table of so many narrow rows at most is sent to every executor.
LOOKUP_ROWS = 100_000
# And a list of so many ids, some 100 MB.
LOOKUP_IDS = 4_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that working columns can't clash with them."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, names: list[str], taken: list[str], row: str = "row") -> list[Column]:
    """The columns of the struct again, but for those whose names the operator's own columns take."""
    own = {x.lower() for x in taken}
    return [F.col(row).getField(c).alias(c) for c in names if c.lower() not in own]


def row_key(df: DataFrame, seed: int) -> Column:
    """A seeded 64-bit key of all columns; equal rows have equal keys."""
    def plain(kind: T.DataType) -> bool:
        text = kind.simpleString()
        return "map<" not in text and "variant" not in text

    return F.xxhash64(F.lit(seed), *[col(f.name) for f in df.schema if plain(f.dataType)])


def cells_for(rows: int) -> int:
    return max(LEAST_CELLS, -(-rows // CELL_ROWS))


def attach(docs: DataFrame, lookup: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``docs`` left-joined to ``lookup`` on ``key``, whatever share of ``docs`` one key holds.

    ``lookup`` has one row per key and in ``count`` the key's rows in ``docs``.  Up to
    ``LOOKUP_ROWS`` rows it is broadcast.  Beyond, the keys with more than ``HOT_SHARE`` of all
    rows (fewer than 1,000) are broadcast and only rows of the others are shuffled.
    """
    if lookup.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return docs.join(F.broadcast(lookup), key, "left")
    hot = F.col(count) > HOT_SHARE * total
    large = lookup.where(hot)
    names = large.select(key)
    return docs.join(F.broadcast(large), key).unionByName(
        docs.join(F.broadcast(names), key, "left_anti").join(lookup.where(~hot), key, "left")
    )


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df`` restricted to (or, with ``left_anti``, rid of) the keys in ``ids``, a table of one column.

    Up to ``LOOKUP_IDS`` ids are counted first and then broadcast, so that ``df`` with its texts isn't
    shuffled; beyond, both sides are.
    """
    if ids.limit(LOOKUP_IDS + 1).count() <= LOOKUP_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)
