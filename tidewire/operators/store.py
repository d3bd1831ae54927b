"""Changes of the article store: ``DataFrame -> DataFrame``, nothing in place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import times
from tidewire.operators.filters import ttl_valid
from tidewire.plans.state import stamped
from tidewire.session import cut, scratch_path

# Rows of one range of a page index.
RANGE_ROWS = 100_000


def store_get(store: DataFrame, id_: str) -> DataFrame:
    return store.where(F.col("id") == id_)


def store_get_many(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_semi")


def store_list(store: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of the store in id order; limit 0 lists all."""
    page = store.orderBy("id")
    if offset:
        page = page.offset(offset)
    return page.limit(limit) if limit else page


class PageIndex:
    """A store laid out in ranges of ids, with the rank at which each range begins.

    The ranges are written in the order of their ids, a folder each; how many rows each holds is summed
    up once.  A page is then read from the ranges it lies in, wherever it begins, and only these are
    sorted.  The index has a row per range, ``range_rows`` times fewer than the store.
    """

    def __init__(self, store: DataFrame, range_rows: int = RANGE_ROWS):
        spark = store.sparkSession
        ranges = max(1, -(-store.count() // range_rows))
        path = scratch_path(spark, "pages")
        dealt = store.repartitionByRange(ranges, "id").withColumn("_range", F.spark_partition_id())
        dealt.write.partitionBy("_range").parquet(path)
        self.columns = store.columns
        self.rows = spark.read.schema(dealt.schema).parquet(path)
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.rows.groupBy("_range").agg(F.count("*").alias("n"))
        self.index = cut(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "page-index")

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in id order."""
        met = self.index.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
        found = met.orderBy("start").collect()
        inside = self.rows.where(F.col("_range").isin([r["_range"] for r in found])).select(*self.columns)
        skipped = offset - found[0]["start"] if found else 0
        return inside.orderBy("id").offset(skipped).limit(limit)


def store_add_many(store: DataFrame, rows: DataFrame) -> DataFrame:
    return store.unionByName(rows, allowMissingColumns=True)


def store_update(store: DataFrame, updates: DataFrame, column: str = "metadata") -> DataFrame:
    """Replace ``column`` where ``updates`` (id, column) names the row; rest untouched."""
    new = updates.select("id", F.col(column).alias("_new"))
    return (
        store.join(new, "id", "left")
        .withColumn(column, F.coalesce("_new", F.col(column)))
        .select(*store.columns)
    )


def store_delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")


def store_clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def store_count(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("count"))


def metadata_where(store: DataFrame, condition: Column) -> DataFrame:
    """Restrict the store before a search, so that the filter reaches the scan."""
    return store.where(condition)


def touch(store: DataFrame, matched: DataFrame, now: Column) -> DataFrame:
    """Matched rows get both retrieval stamps and ``last_update`` set to ``now``.

    Many rows may match one stored row, so ids are made distinct first; ids not
    in the store have no effect.
    """
    hits = matched.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return (
        store.join(hits, "id", "left")
        .withColumn("metadata", F.when(hit, stamped(F.col("metadata"), now)).otherwise(F.col("metadata")))
        .withColumn("last_update", F.when(hit, now).otherwise(F.col("last_update")))
        .select(*store.columns)
    )


def resolve_stamps(store: DataFrame) -> DataFrame:
    """Set ``last_update`` from the metadata's first parseable stamp."""
    return store.withColumn("last_update", times.last_update_resolve(F.col("metadata")))


def evictions(store: DataFrame, now: datetime) -> DataFrame:
    """``id, reason`` of rows a check would delete."""
    return store.select(
        "id",
        F.when(F.col("last_update").isNull(), "invalid or missing TTL metadata")
        .when(~ttl_valid(F.col("last_update"), F.lit(now)), "exceeded TTL")
        .alias("reason"),
    ).where("reason is not null")


def ttl_cleanup(store: DataFrame, now: datetime) -> DataFrame:
    return store.where(ttl_valid(F.col("last_update"), F.lit(now)))
