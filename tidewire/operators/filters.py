"""Row tests.  Rejected rows keep a reason; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, lifetimes and request messages.
SIMILARITY_THRESHOLD = 0.95
NEIGHBOURS = 5
TTL_SECONDS = 24 * 60 * 60
REQUEST_MESSAGES = {
    "status": "Input status must be 'success'",
    "uuid": "UUID is required",
    "voiceover": "Voiceover URL is required",
    "captions": "Subtitle timestamps are required",
}


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def extraction_ok(error: Column) -> Column:
    return _blank(error)


def message_valid(status: Column, uuid: Column) -> Column:
    """Messages the captioning side takes."""
    return F.coalesce(status == "success", F.lit(False)) & ~_blank(uuid)


def payload_valid(uuid: Column) -> Column:
    """Messages the run side takes: successes and failures alike."""
    return ~_blank(uuid)


def message_reject(status: Column, uuid: Column) -> Column:
    return F.when(
        ~F.coalesce(status == "success", F.lit(False)),
        F.concat(F.lit("status: "), F.coalesce(status, F.lit(""))),
    ).when(_blank(uuid), "missing uuid")


def request_reject(status: Column, uuid: Column, voiceover: Column, words: Column) -> Column:
    """First failing check of a processing request, NULL when it is fine."""
    return (
        F.when(~F.coalesce(status == "success", F.lit(False)), REQUEST_MESSAGES["status"])
        .when(_blank(uuid), REQUEST_MESSAGES["uuid"])
        .when(_blank(voiceover), REQUEST_MESSAGES["voiceover"])
        .when(F.coalesce(F.size(words), F.lit(0)) <= 0, REQUEST_MESSAGES["captions"])
    )


def effective_threshold(threshold: float = 0.0) -> float:
    return threshold or SIMILARITY_THRESHOLD


def effective_k(k: int = 0) -> int:
    return k or NEIGHBOURS


def similarity_threshold(sim: Column, threshold: float = 0.0) -> Column:
    return sim >= effective_threshold(threshold)


def ttl_valid(last_update: Column, now: Column) -> Column:
    """Fresh until strictly more than 24 hours old."""
    return last_update >= now - F.expr("interval 24 hours")


def bad_metadata(last_update: Column) -> Column:
    return last_update.isNull()


def positive_best(sim: Column) -> Column:
    return sim > 0


def only_new(status: Column) -> Column:
    return status == "new"
