"""Stories: the first article of a matter and all near-duplicates appended to it.

A story is kept as rows ``id, run, seq, title, text``, one per segment, so that an
append adds rows and never rewrites, and a much-matched story is no large value.
``seq`` is the order inside a run; a later run's segments follow those of earlier ones.
Its text is one body, and several that follow each other only if it is very large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.html import strip_images
from tidewire.operators.ordered import PART_BYTES, ordered_parts
from tidewire.operators.spread import spread_join

# Fixed value: what separates the segments of a story.
SEGMENT_MARK = "\n--\n"


def story_create(segments: DataFrame, new: DataFrame, run: int = 0) -> DataFrame:
    """Start a story per new article (``seq, id, title, body``); an existing id is replaced."""
    first = new.select(
        "id",
        F.lit(run).cast("long").alias("run"),
        "seq",
        "title",
        F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text"),
    )
    return segments.join(new.select("id"), "id", "left_anti").unionByName(first)


def append_rows(similar: DataFrame, run: int = 0) -> DataFrame:
    """Segments of similar articles (``seq, matching_id, title, body``)."""
    return similar.select(
        F.col("matching_id").alias("id"),
        F.lit(run).cast("long").alias("run"),
        "seq",
        "title",
        F.coalesce("body", F.lit("")).alias("text"),
    )


def story_append(
    segments: DataFrame, similar: DataFrame, total: int = 0, floor: int | None = None, run: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``(segments, missing)``: appends to stories that exist, and the rest with their reason.

    The story ids are one row each; a story that takes most appends is split.
    """
    rows = append_rows(similar, run)
    ids = segments.select("id").distinct()
    known = spread_join(rows, ids, ["id"], "left_semi", "seq", total, floor)
    missing = spread_join(rows, ids, ["id"], "left_anti", "seq", total, floor)
    return (
        segments.unionByName(known.select(*segments.columns)),
        missing.select("id", "seq", F.lit("failed to get object").alias("error")),
    )


def append_concat(segments: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``id, part, body``: segments in order of run and ``seq``, joined by the mark."""
    parts = ordered_parts(segments, ["id"], ["run", "seq"], F.col("text"), "texts", part_bytes)
    return parts.select("id", "part", F.array_join("texts", SEGMENT_MARK).alias("body"))


def write_stories(segments: DataFrame, path: str, prefix: str = "", part_bytes: int = PART_BYTES) -> None:
    """Rendered parts as a table keyed by object key."""
    (
        append_concat(segments, part_bytes)
        .withColumn("key", X.object_key(F.lit(prefix), F.col("id")))
        .write.mode("overwrite")
        .parquet(path)
    )


def stories_after(
    segments: DataFrame, articles: DataFrame, results: DataFrame, total: int = 0, run: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Stories after a dedup run: creates first, then appends; exact duplicates do nothing."""
    bodies = articles.select(
        "seq",
        F.coalesce("title", F.lit("")).alias("title"),
        X.stored_body(F.col("full_content_text"), F.col("full_content"), F.col("summary")).alias("body"),
    )
    judged = results.select("seq", "id", "status", "is_exact_duplicate", "matching_id").join(bodies, "seq")
    made = story_create(segments, judged.where("status = 'new'").select("seq", "id", "title", "body"), run)
    similar = judged.where("status = 'duplicate' and not is_exact_duplicate")
    return story_append(made, similar.select("seq", "matching_id", "title", "body"), total, run=run)


def story_log(
    known: DataFrame, articles: DataFrame, results: DataFrame, total: int = 0, run: int = 0, floor: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(log, missing)`` of one dedup run: the segments it adds to the log, and appends to no story.

    ``known`` has the ``id`` of every story before the run.  The log is only ever added to: a story's
    start carries ``starts`` and what an earlier run wrote under its id is left out when the log is read.
    """
    made, missing = stories_after(
        known.select(
            "id", F.lit(-1).cast("long").alias("run"), F.lit(-1).cast("long").alias("seq"),
            F.lit("").alias("title"), F.lit("").alias("text"),
        ),
        articles, results, total, run,
    )
    starts = results.where("status = 'new'").select("id", "seq", F.lit(True).alias("starts"))
    added = made.where(F.col("run") == run)
    return (
        added.join(starts, ["id", "seq"], "left").select(*added.columns, F.coalesce("starts", F.lit(False)).alias("starts")),
        missing,
    )


def log_segments(log: DataFrame, total: int = 0, floor: int | None = None) -> DataFrame:
    """The log merged: every story's segments from the run that started it last.

    The starts are aggregated before the shuffle; a story that holds most segments is split.
    """
    begun = log.where("starts").groupBy("id").agg(F.max("run").alias("_from"))
    met = spread_join(log, begun, ["id"], "inner", "seq", total, floor)
    return met.where("run >= _from").drop("_from")


def article_export(articles: DataFrame, prefix: str = "") -> DataFrame:
    """``key, json``: article without its image, images cut out of its HTML."""
    payload = F.struct(
        "id", "title", "url", "published_at", "fetched_at", "summary", "author", "categories",
        "excerpt",
        strip_images(F.col("full_content")).alias("full_content"),
        F.col("full_content_text").alias("content_text"),
    )
    return articles.select(
        X.export_key(F.lit(prefix), F.col("id")).alias("key"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("json"),
    )
