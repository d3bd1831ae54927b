"""Quality rules of documents and of their hosts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import common as C
from tidewire.session import cut

SYMBOLS = "#*$%&|<>"
# A host whose shrunk failure rate is above this is suspect.
SUSPECT_RATE = 0.5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_calls"]


def repeated_words(words: list[bytes], span: int = 5) -> int:
    """Words in windows of five that the text has twice or more, the first ones included."""
    if len(words) <= span:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    kinds = len(numbers) + 1
    two = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
    five, counts = np.unique(four[:-1] * kinds + ids[4:], return_inverse=True, return_counts=True)[1:]
    starts = np.flatnonzero(counts[five] > 1)
    if not len(starts):
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + span, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """``STATS`` of a whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (
        len(words),
        len(text) - blank,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        text.count("!"),
    )


def measured(df: DataFrame, text: str) -> DataFrame:
    """(row, STATS...): the statistics of every text."""
    frame = df.select(C.packed(df.drop(text)), C.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py() or "") for t in batch.column("text")]
            cols = np.array(found, np.int64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, cols)], names=["row", *STATS])

    kind = T.StructType([frame.schema["row"], *[T.StructField(c, T.LongType()) for c in STATS]])
    return frame.mapInArrow(run, kind)


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def beyond(limit: int) -> Column:
    """Any of the softer rules is broken by more than ``limit`` times what it allows."""
    return F.expr(
        f"""10 * n_symbols > {limit} * n_words
        or 10 * n_dup_lines > 3 * {limit} * n_lines
        or 2 * n_calls > {limit} * n_words
        or word_chars > 12 * {limit} * n_words
        or 5 * {limit} * word_chars < 10 * n_words"""
    )


def host_rates(docs: DataFrame) -> DataFrame:
    """(host, n, rate) from (host, failed): each host's failure rate, shrunk by a beta prior.

    The prior is fitted to the hosts by moments: its mean is the rate over all documents, its
    weight what the hosts' rates vary beyond chance.  Only sums by host are shuffled.
    """
    hosts = docs.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f")
    )
    r = hosts.agg(
        F.count(F.lit(1)).alias("h"),
        F.sum("n").alias("n"),
        F.sum("f").alias("f"),
        F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    n = r["n"] or 0
    mean = (r["f"] or 0) / n if n else 0.0
    weight = 10.0
    if n and r["h"] > 1 and 0 < mean < 1:
        chance = mean * (1 - mean)
        spread = (r["ff"] - n * mean * mean - (r["h"] - 1) * chance) / max(n - r["nn"] / n, 1e-9)
        weight = min(max(chance / max(spread, 1e-9) - 1, 2.0), 10_000.0)
    return hosts.select("host", "n", ((F.col("f") + mean * weight) / (F.col("n") + weight)).alias("rate"))


def judge(df: DataFrame, host: str, text: str = "text") -> DataFrame:
    """(row, STATS..., base_failed, host_rate, kept) of every row; ``row`` has all columns but the text.

    A document that fails the base rules goes.  Failures of any rule are added up by host; a host
    is suspect if its shrunk rate is above one half.  The verdict is joined back: from a suspect
    host a document goes if it breaks any of the softer rules, from others if it breaks one by
    more than twice what it allows.  A document that breaks no rule is kept whatever its host.

    Null and empty texts have no words and go.  Null hosts are one host.  Equal rows fare alike.
    Texts are read once and never shuffled; hot hosts neither.
    """
    rows = cut(measured(df, text).withColumn("base_failed", base_failed()), "rules-measured")
    name = F.concat(F.lit("="), F.col("row").getField(host).cast("string"))
    named = rows.withColumn("host", F.coalesce(name, F.lit("-")))
    rates = cut(
        host_rates(named.select("host", (F.col("base_failed") | beyond(1)).alias("failed"))), "rules-hosts"
    )
    found = C.attach(named, rates, "host", "n", rows.count())
    broken = F.when(F.col("rate") > SUSPECT_RATE, beyond(1)).otherwise(beyond(2))
    return found.select(
        "row", *STATS, "base_failed", F.col("rate").alias("host_rate"), (~F.col("base_failed") & ~broken).alias("kept")
    )
