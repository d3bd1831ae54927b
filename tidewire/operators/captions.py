"""Caption lines, word events and caption files for tables of messages.

The outer generators are deliberate: from an inner one Spark infers a filter on
the array and evaluates the array a second time below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import captions as C


def with_lines(messages: DataFrame, words: str = "subtitle_timestamps") -> DataFrame:
    """Add ``lines``: the word array cut into caption lines."""
    ends = messages.withColumn("_ends", C.line_ends(F.col(words)))
    return ends.withColumn("lines", C.lines_between(F.col(words), F.col("_ends"))).drop("_ends")


def caption_lines(messages: DataFrame, words: str = "subtitle_timestamps") -> DataFrame:
    """One row per caption line: ``uuid, line, n_words, start, end, text``."""
    return (
        with_lines(messages, words)
        .select("uuid", F.posexplode_outer("lines").alias("line", "ws"))
        .where("line is not null")
        .select(
            "uuid",
            "line",
            F.size("ws").alias("n_words"),
            F.col("ws")[0]["start"].alias("start"),
            F.get("ws", F.size("ws") - 1)["end"].alias("end"),
            F.array_join(F.col("ws")["text"], " ").alias("text"),
        )
    )


def with_events(messages: DataFrame, words: str = "subtitle_timestamps") -> DataFrame:
    """Add ``events``: one highlighted event per word."""
    return with_lines(messages, words).withColumn("events", C.line_events(F.col("lines")))


def caption_events(messages: DataFrame, words: str = "subtitle_timestamps") -> DataFrame:
    """One row per word event: ``uuid, line, pos, start, end, text``."""
    return with_events(messages, words).select("uuid", F.inline_outer("events")).where(
        "line is not null"
    )


def ass_files(messages: DataFrame, title: str = "Captions") -> DataFrame:
    """``uuid, script``; messages without words give no file."""
    worded = messages.where(F.size("subtitle_timestamps") > 0)
    return with_events(worded).select(
        "uuid", C.ass_script(F.col("events"), title).alias("script")
    )


def srt_files(messages: DataFrame, words: str = "subtitle_timestamps") -> DataFrame:
    return messages.where(F.size(words) > 0).select(
        "uuid", C.srt_script(F.col(words)).alias("script")
    )


def clip_durations(messages: DataFrame, words: str = "subtitle_timestamps") -> DataFrame:
    """``uuid, duration, reject_reason``; a message without words cannot be cut."""
    duration = C.clip_duration(F.col(words))
    return messages.select(
        "uuid",
        duration.alias("duration"),
        F.when(duration.isNull(), F.lit("no captions")).alias("reject_reason"),
    )
