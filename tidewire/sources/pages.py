"""Landed HTML pages joined to articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import html as H
from tidewire.functions import text as X


def extract_pages(pages: DataFrame) -> DataFrame:
    """``url, content, text, excerpt, image, byline`` of every page, in the row."""
    content = pages.select("url", "html", H.main_content(F.col("html")).alias("content"))
    read = content.withColumn("text", H.plain_text(F.col("content")))
    return read.select(
        "url",
        "content",
        "text",
        H.excerpt(F.col("html"), F.col("text")).alias("excerpt"),
        H.lead_image(F.col("html")).alias("image"),
        H.byline(F.col("html")).alias("byline"),
    )


def one_per_url(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The page of each wanted URL: that of the smallest ``page_id``, or the smallest text without
    ids.  Pages nobody asks for and those without a URL aren't read further."""
    asked = wanted.select("url").where("url <> ''").distinct()
    found = pages.join(asked, "url", "left_semi")
    if "page_id" not in pages.columns:
        return found.groupBy("url").agg(F.min("html").alias("html"))
    firsts = found.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return found.join(firsts, ["url", "page_id"], "left_semi").dropDuplicates(["url"])


def _keyed(rows: DataFrame, url: str) -> DataFrame:
    """``rows`` with ``_key``: the URL; rows without one get a key of their own each, which no page has,
    so that they don't meet in one task.  Columns of any type may stand beside it."""
    own = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    return rows.withColumn("_key", F.when(F.coalesce(F.col(url), F.lit("")) == "", own).otherwise(F.col(url)))


def page_titles(pages: DataFrame) -> DataFrame:
    return pages.select("url", H.html_title(F.col("html")).alias("page_title"))


def page_extract(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill articles from their pages; a row that cannot be filled says why.

    Of several pages of one URL one is taken.
    """
    found = (
        extract_pages(one_per_url(pages, articles))
        .withColumnRenamed("url", "_url")
        .withColumnRenamed("excerpt", "_excerpt")
        .withColumn("_found", F.lit(True))
    )
    ok = F.col("_found").isNotNull() & (F.coalesce("url", F.lit("")) != "")
    error = F.when(F.coalesce("url", F.lit("")) == "", "article URL is empty").when(
        F.col("_found").isNull(), "page not found"
    )
    filled = {
        "full_content": F.when(ok, F.col("content")).otherwise(F.col("full_content")),
        "full_content_text": F.when(ok, F.col("text")).otherwise(F.col("full_content_text")),
        "excerpt": F.when(ok, F.col("_excerpt")).otherwise(F.col("excerpt")),
        "image_url": F.when(ok, X.enrich_fill(F.col("image_url"), F.col("image"))).otherwise(F.col("image_url")),
        "author": F.when(ok, X.enrich_fill(F.col("author"), F.col("byline"))).otherwise(F.col("author")),
        "extraction_error": error,
    }
    return _keyed(articles, "url").join(found, F.col("_key") == F.col("_url"), "left").select(
        *[filled.get(c, F.col(c)).alias(c) for c in articles.columns]
    )


def page_lookup(rows: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Left join of ``page_title`` on ``url``."""
    wanted = rows.select(F.col(url).alias("url"))
    titles = page_titles(one_per_url(pages, wanted)).withColumnRenamed("url", "_url")
    return _keyed(rows, url).join(titles, F.col("_key") == F.col("_url"), "left").drop("_key", "_url")
