"""Publishing metadata of decoded messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.sources.pages import page_lookup


def choose_titles(messages: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``chosen_title``: own title, else title of the first source's page, else first words."""
    first = messages.withColumn("_first_url", F.get("article_urls", F.lit(0)))
    joined = page_lookup(first, pages, "_first_url")
    return joined.withColumn(
        "chosen_title",
        X.title_choice(F.col("title"), F.col("page_title"), F.col("subtitle_timestamps")),
    ).drop("_first_url", "page_title")


def publish_metadata(messages: DataFrame) -> DataFrame:
    """``uuid, title, description, tags, category_id`` from ``chosen_title`` and sources."""
    return messages.select(
        "uuid",
        X.truncate_ellipsis(F.col("chosen_title")).alias("title"),
        X.publish_description(F.col("article_urls"), X.source_url(F.col("source_url"))).alias(
            "description"
        ),
        X.publish_tags().alias("tags"),
        F.lit(X.PUBLISH_CATEGORY).alias("category_id"),
    )


def upload_metadata(uploads: DataFrame) -> DataFrame:
    """Defaults of a manual upload: ``path, title, description, source, tags, category_id``.

    Other columns pass through.
    """
    given = ("path", "title", "description", "source", "tags", "category_id")
    titled = uploads.withColumn("_title", X.upload_title(F.col("title"), F.col("path")))
    return titled.select(
        *[c for c in uploads.columns if c not in given],
        "path",
        F.col("_title").alias("title"),
        X.upload_description(F.col("description"), F.col("_title"), F.col("source")).alias("description"),
        X.parse_tags(F.col("tags")).alias("tags"),
        F.coalesce(X.nonempty(F.col("category_id")), F.lit(X.PUBLISH_CATEGORY)).alias("category_id"),
    )
