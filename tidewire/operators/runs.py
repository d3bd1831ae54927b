"""What a run reports: counts, status, logs, payloads and the generation request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators.ordered import PART_BYTES, ordered_parts

# Log sizes and statuses.
LOG_KEPT = 50
LOG_SHOWN = 10
STATUSES = ("new", "duplicate", "failed", "error")
# What a received payload does to its run.
STATE_COMPLETE = "complete"
PAYLOAD_LOGGED = "Webhook received from generation service!"


def status_counts(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES]
    return results.groupBy(*(by or [])).agg(*counts)


def summary_folded(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals with failures and errors in one count, and extraction success."""
    failed = F.col("status").isin("failed", "error")
    extracted = F.count_if(F.col("status") != "failed")
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "new").alias("new_count"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_count"),
        F.count_if(failed).alias("failed_count"),
        F.concat(extracted.cast("string"), F.lit("/"), F.count("*").cast("string")).alias("extracted"),
    )


def new_urls(results: DataFrame, by: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """URLs of new articles in processing order, empty ones included: one list per run, cut into
    parts only if it is very large."""
    new = results.where(F.col("status") == "new")
    return ordered_parts(new, by, ["seq"], F.coalesce("url", F.lit("")), "article_urls", part_bytes)


def first_new_ref(results: DataFrame, by: list[str]) -> DataFrame:
    """First non-empty object reference among new articles."""
    new = results.where((F.col("status") == "new") & X.nonempty(F.col("object_key")).isNotNull())
    return new.groupBy(*by).agg(F.min_by("object_key", "seq").alias("object_ref"))


def generation_requests(results: DataFrame, by: list[str]) -> DataFrame:
    """One request per run that has a reference; other runs complete without one.

    The request id is a hash of what it asks for, so that a retried run asks
    for the same thing.  ``article_urls`` are those of the new articles, in order;
    a list too large for one row goes on in further rows of the same request.
    """
    new = results.where(F.col("status") == "new")
    ref = F.min_by(
        F.col("object_key"),
        F.when(X.nonempty(F.col("object_key")).isNotNull(), F.col("seq")),
    )
    asked = (
        new.groupBy(*by)
        .agg(
            ref.alias("object_ref"),
            F.count("*").alias("n_urls"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
        )
        .where(X.nonempty(F.col("object_ref")).isNotNull())
        .withColumn(
            "uuid",
            X.article_id(F.concat_ws("|", *by, "object_ref", "n_urls", "first_seq", "last_seq")),
        )
        .select(*by, "uuid", "object_ref", "n_urls")
    )
    return asked.join(new_urls(results, by), by).select(
        *by, "uuid", "object_ref", "n_urls", "part", "article_urls"
    )


def latest_payload(
    messages: DataFrame, by: list[str], value: str = "value", match_uuid: str | None = None
) -> DataFrame:
    """Last message wins, whatever its status or uuid.

    With ``match_uuid``, the column of the uuid that the run asked for, only messages
    whose own ``uuid`` is that one count.
    """
    if match_uuid is not None:
        messages = messages.where(F.col("uuid") == F.col(match_uuid))
    return messages.groupBy(*by).agg(
        F.max_by(value, "offset").alias("payload"), F.max("offset").alias("offset")
    )


def completions(payloads: DataFrame, by: list[str]) -> DataFrame:
    """The log rows by which a payload completes its run: ``by, seq, state, error, message``."""
    return payloads.select(
        *by,
        F.col("offset").alias("seq"),
        F.lit(STATE_COMPLETE).alias("state"),
        F.lit(None).cast("string").alias("error"),
        F.lit(PAYLOAD_LOGGED).alias("message"),
    )


def run_status(results: DataFrame, logs: DataFrame, by: list[str]) -> DataFrame:
    """One row per run: last state and error of its log, and its result counts.

    ``logs``: ``by, seq, state, error``; both sides are aggregated before they meet.
    """
    counted = results.groupBy(*by).agg(
        F.count("*").alias("article_count"),
        F.count_if(F.col("status") == "new").alias("new_count"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_count"),
    )
    last = logs.groupBy(*by).agg(
        F.max_by("state", F.when(F.col("state").isNotNull(), F.col("seq"))).alias("state"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"),
    )
    zero = F.lit(0).cast("long")
    return last.join(counted, by, "full").select(
        *by,
        F.coalesce("state", F.lit("idle")).alias("state"),
        F.coalesce("error", F.lit("")).alias("error"),
        *[F.coalesce(c, zero).alias(c) for c in ("article_count", "new_count", "duplicate_count")],
    )


def last_n_log(logs: DataFrame, by: list[str], n: int = LOG_KEPT) -> DataFrame:
    """The last n log rows of each run; Spark limits each side of the shuffle to n."""
    order = Window.partitionBy(*by).orderBy(F.desc("timestamp"), F.desc("seq"))
    return logs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def payload_report(messages: DataFrame) -> DataFrame:
    """Preview, caption count and timings of decoded messages, beside their offset."""
    timings = F.transform(
        F.map_entries("timings"),
        lambda t: F.concat(t["key"], F.lit("="), F.format_string("%.2fs", t["value"])),
    )
    return messages.select(
        "offset",
        "uuid",
        "status",
        F.coalesce("error", F.lit("")).alias("error"),
        X.preview(F.coalesce("voiceover", F.lit(""))).alias("voiceover_preview"),
        F.greatest(F.size("subtitle_timestamps"), F.lit(0)).alias("captions"),
        F.greatest(F.size("timings"), F.lit(0)).alias("n_timings"),
        F.array_join(timings, " ").alias("timings"),
    )
