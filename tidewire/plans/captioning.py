"""From messages to caption files and publishing metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import captions as CP
from tidewire.operators.publish import choose_titles, publish_metadata
from tidewire.streaming.messages import CREATION, route


@dataclass
class Captioned:
    scripts: DataFrame
    durations: DataFrame
    metadata: DataFrame
    rejected: DataFrame


def caption(envelopes: DataFrame, pages: DataFrame, title: str = "Captions") -> Captioned:
    """Decode and check messages; write captions and metadata for those with words."""
    good, dead, _ = route(envelopes, CREATION)
    worded = good.where(F.size("subtitle_timestamps") > 0)
    wordless = good.where(F.coalesce(F.size("subtitle_timestamps"), F.lit(0)) <= 0).select(
        *envelopes.columns, F.lit("no captions").alias("reject_reason")
    )
    return Captioned(
        CP.ass_files(worded, title),
        CP.clip_durations(worded),
        publish_metadata(choose_titles(worded, pages)),
        dead.unionByName(wordless),
    )
