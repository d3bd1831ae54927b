"""Timestamps: feed dates, stored stamps and clip times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stamp keys in the order they are tried, and time formats.
STAMP_KEYS = ("last_update", "last_retrieved_at", "added_at")
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
)
FEED_DATE_FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm Z",
    "d MMM yyyy HH:mm z",
    "d MMM yy HH:mm:ss Z",
    "d MMM yy HH:mm:ss z",
    "d MMM yy HH:mm Z",
    "d MMM yy HH:mm z",
    "d-MMM-yy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)


def parse_rfc3339(text: Column) -> Column:
    """Strict RFC 3339; blank, date-only and garbled text give NULL."""
    return F.when(
        text.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(text, ",", "."))
    )


def format_rfc3339(ts: Column) -> Column:
    """UTC with second precision; the session time zone is UTC throughout."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_feed_date(text: Column) -> Column:
    """RFC 822 dates of RSS, with years of two or four digits, RFC 3339 dates of Atom, and dates
    that feeds commonly have instead."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(fmt)) for fmt in FEED_DATE_FORMATS]
    return F.coalesce(parse_rfc3339(F.trim(text)), *tries)


def published_at(published: Column, updated: Column) -> Column:
    return F.coalesce(parse_feed_date(published), parse_feed_date(updated))


def last_update_resolve(metadata: Column) -> Column:
    """First stamp that parses, in the order of ``STAMP_KEYS``."""
    return F.coalesce(*[parse_rfc3339(F.try_element_at(metadata, F.lit(k))) for k in STAMP_KEYS])


def _whole(seconds: Column) -> Column:
    """Truncating cast, as every step of the clip time formats does."""
    return seconds.cast("int")


def _clock(seconds: Column) -> tuple[Column, Column, Column]:
    hours = _whole(seconds / 3600)
    minutes = _whole((seconds - hours * 3600) / 60)
    return hours, minutes, _whole(seconds) % 60


def fmt_ass_time(seconds: Column) -> Column:
    """``h:mm:ss.cc``"""
    cents = _whole((seconds - _whole(seconds)) * 100)
    return F.format_string("%d:%02d:%02d.%02d", *_clock(seconds), cents)


def fmt_srt_time(seconds: Column) -> Column:
    """``hh:mm:ss,mmm``"""
    millis = _whole((seconds - _whole(seconds)) * 1000)
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(seconds), millis)
