"""Caption rules on word arrays.

A message carries its words as one array, so lines and events are built with
array functions inside the row: no explode, no shuffle, no window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import trim_space
from tidewire.functions.times import fmt_ass_time, fmt_srt_time

# Clip limits, colours and the caption script's frame.
WORDS_PER_LINE = 5
END_PADDING = 0.5
MAX_CLIP_SECONDS = 180.0
FONT_SIZE = 90
HIGHLIGHT_ON = r"{\c&H0000FFFF&}"
HIGHLIGHT_OFF = r"{\c&H00FFFFFF&}"
STYLE_FIELDS = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, "
    "Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, "
    "Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
STYLE_TAIL = "&H00000000,&H00000000,-1,0,0,0,100,100,0,0,1,3,0,2,40,40,768,1"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
SENTENCE_END = r"[.!?]\z"
NUMBER_PERIOD = r"(^|[0-9])[0-9][.]\z"


def ass_header(title: str = "Captions") -> str:
    """Script head; the title is free text, the rest is fixed."""
    white, yellow = "&H00FFFFFF", "&H0000FFFF"
    return "\n".join(
        [
            "[Script Info]",
            f"Title: {title}",
            "ScriptType: v4.00+",
            "PlayResX: 1080",
            "PlayResY: 1920",
            "",
            "[V4+ Styles]",
            f"Format: {STYLE_FIELDS}",
            f"Style: Default,Consolas,{FONT_SIZE},{white},{white},{STYLE_TAIL}",
            f"Style: Highlight,Consolas,{FONT_SIZE},{yellow},{yellow},{STYLE_TAIL}",
            "",
            "[Events]",
            f"Format: {EVENT_FIELDS}",
            "",
        ]
    )


def sentence_end(text: Column) -> Column:
    """Ends in ``.``, ``!`` or ``?``, unless the period closes a number."""
    word = trim_space(text)
    return word.rlike(SENTENCE_END) & ~word.rlike(NUMBER_PERIOD)


def line_ends(words: Column) -> Column:
    """Positions that close a sentence; the last word always does."""
    marked = F.transform(
        words,
        lambda w, i: F.when(sentence_end(w["text"]) | (i == F.size(words) - 1), i),
    )
    return F.array_compact(marked)


def lines_between(words: Column, ends: Column, limit: int = WORDS_PER_LINE) -> Column:
    """Caption lines: each sentence cut every ``limit`` words."""
    n = F.size(ends)
    begins = F.transform(
        F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.greatest(n - 1, F.lit(0)))), lambda e: e + 1
    )
    spans = F.arrays_zip(begins.alias("lo"), ends.alias("hi"))
    cut = F.transform(
        spans,
        lambda s: F.transform(
            F.sequence(s["lo"], s["hi"], F.lit(limit)),
            lambda at: F.transform(
                F.sequence(at, F.least(at + (limit - 1), s["hi"])), lambda j: F.get(words, j)
            ),
        ),
    )
    return F.when(n > 0, F.flatten(cut))


def highlight_line(line: Column, at: Column) -> Column:
    """The line's words, the one at ``at`` coloured."""
    return F.array_join(
        F.transform(
            line,
            lambda w, i: F.when(
                i == at, F.concat(F.lit(HIGHLIGHT_ON), w["text"], F.lit(HIGHLIGHT_OFF))
            ).otherwise(w["text"]),
        ),
        " ",
    )


def line_events(lines: Column) -> Column:
    """One event per word, shown until the next word of the same line starts."""
    return F.flatten(
        F.transform(
            lines,
            lambda line, n: F.transform(
                line,
                lambda w, i: F.struct(
                    n.alias("line"),
                    i.alias("pos"),
                    w["start"].alias("start"),
                    F.coalesce(F.get(line, i + 1)["start"], w["end"]).alias("end"),
                    highlight_line(line, i).alias("text"),
                ),
            ),
        )
    )


def clip_duration(words: Column) -> Column:
    """Last word's end plus padding, at most three minutes; NULL without words."""
    last = F.get(words, F.size(words) - 1)["end"]
    return F.when(
        F.size(words) > 0, F.least(last + END_PADDING, F.lit(MAX_CLIP_SECONDS))
    )


def dialogue(event: Column) -> Column:
    return F.concat(
        F.lit("Dialogue: 0,"),
        fmt_ass_time(event["start"]),
        F.lit(","),
        fmt_ass_time(event["end"]),
        F.lit(",Default,,0,0,0,,"),
        event["text"],
        F.lit("\n"),
    )


def ass_script(events: Column, title: str = "Captions") -> Column:
    return F.concat(
        F.lit(ass_header(title)), F.array_join(F.transform(events, dialogue), "")
    )


def srt_cue(word: Column, i: Column) -> Column:
    return F.concat(
        (i + 1).cast("string"),
        F.lit("\n"),
        fmt_srt_time(word["start"]),
        F.lit(" --> "),
        fmt_srt_time(word["end"]),
        F.lit("\n"),
        word["text"],
        F.lit("\n\n"),
    )


def srt_script(words: Column) -> Column:
    return F.array_join(F.transform(words, srt_cue), "")
