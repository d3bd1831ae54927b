"""What one run leaves to the next: stored vectors and remembered keys."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions import times
from tidewire.functions.vectors import KEY_TYPE, VECTOR_TYPE
from tidewire.operators.filters import TTL_SECONDS, ttl_valid


def store_schema(vector_type: str) -> str:
    return (
        f"id string, content string, vec {vector_type}, keys array<{KEY_TYPE}>, "
        "metadata map<string,string>, last_update timestamp, model_name string"
    )


@dataclass
class State:
    """``store`` as in ``store_schema``, ``seen`` as in ``schemas.SEEN``.

    ``last_add_at`` is the time of the last addition to ``seen``, which expires
    as a whole.  A ``blank`` store is known to hold nothing.  ``filters``, if given,
    are Bloom filters that hold at least the keys of ``seen``.
    """

    store: DataFrame
    seen: DataFrame
    last_add_at: datetime | None = None
    blank: bool = False
    filters: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession, vector_type: str = VECTOR_TYPE) -> "State":
        return State(
            spark.createDataFrame([], store_schema(vector_type)),
            spark.createDataFrame([], schemas.SEEN),
            blank=True,
        )

    def seen_at(self, now: datetime) -> DataFrame:
        """Remembered keys, none at all 24 hours after the last addition."""
        if self.last_add_at is None or (now - self.last_add_at).total_seconds() >= TTL_SECONDS:
            return self.seen.limit(0)
        return self.seen

    def fresh_store(self, now: datetime) -> DataFrame:
        """Stored rows with a valid stamp of the last 24 hours."""
        return self.store.where(ttl_valid(F.col("last_update"), F.lit(now)))


def stamped(metadata: Column, now: Column) -> Column:
    """Metadata with both retrieval stamps set to ``now`` and the rest kept."""
    stamp = times.format_rfc3339(now)
    rest = F.map_filter(metadata, lambda k, v: ~k.isin("last_retrieved_at", "last_update"))
    return F.map_concat(
        rest, F.create_map(F.lit("last_retrieved_at"), stamp, F.lit("last_update"), stamp)
    )


def store_metadata(now: Column) -> Column:
    """Metadata of a newly stored article, from the article columns."""
    stamp = times.format_rfc3339(now)
    zero_time = F.lit("0001-01-01T00:00:00Z")

    def entry(key: str, value: Column) -> list[Column]:
        return [F.lit(key), value]

    base = F.create_map(
        *entry("article_id", F.col("id")),
        *entry("title", F.coalesce("title", F.lit(""))),
        *entry("url", F.coalesce("url", F.lit(""))),
        *entry("published_at", F.coalesce(times.format_rfc3339(F.col("published_at")), zero_time)),
        *entry("fetched_at", F.coalesce(times.format_rfc3339(F.col("fetched_at")), zero_time)),
        *entry("author", F.coalesce("author", F.lit(""))),
        *entry("last_retrieved_at", stamp),
        *entry("last_update", stamp),
        *entry("added_at", stamp),
    )
    return F.when(
        F.coalesce(F.size("categories"), F.lit(0)) > 0,
        F.map_concat(
            base, F.create_map(F.lit("categories"), F.array_join("categories", ", "))
        ),
    ).otherwise(base)
