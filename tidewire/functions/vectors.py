"""Hashed term vectors and the set of keys two similar texts must share.

The default embedder is offline: words, hashed to 60 bits, weighted by term
count and inverse document frequency, scaled to length one.  The document
frequencies are counted per leading 24 bits, so the model stays small enough to
broadcast whatever the corpus, while the terms themselves stay apart.  They are
fitted once, saved, and reused; vectors of two fits must not be compared, so
every stored row carries the model's name.

Keys.  Order the terms of every text from rare to common and take the shortest
head whose remaining tail is shorter than the threshold.  If two unit vectors
share no head term, their dot product is at most the length of one tail, which
is below the threshold.  So joining on head terms finds every similar pair.

Heads are taken a little longer than that (``HEAD_SLACK``) and every key carries
its weight, the squared length up to and including it and the length of the tail.
Those bound the dot product of two texts from their shared keys alone, so pairs
that only share a stray rare word are refused before any vector is fetched.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word boundary and widths of terms and of frequency slots.
WORD_GAP = r"[^\p{L}\p{N}]+"
TERM_HEX = 15
SLOT_SHIFT = 36
SLOTS = 2**24
DOC_COUNT_ROW = -1
VECTOR_TYPE = "struct<f:array<bigint>,w:array<double>>"
HEAD_SLACK = 0.02
ROUNDING = 1e-5
KEY_TYPE = "struct<k:bigint,w:float,c:float,r:float>"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda t: t != "")


def term(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, TERM_HEX), 16, 10).cast("long")


def slot(term_: Column) -> Column:
    return F.shiftright(term_, SLOT_SHIFT).cast("int")


def _shift(a: Column, by: int, fill: Column) -> Column:
    """The array moved one place, so that neighbours can be zipped.

    Looking a neighbour up by index would name the whole array inside a lambda;
    if the planner then inlines the array, every element recomputes it.
    """
    n = F.size(a)
    if by > 0:
        return F.concat(F.array(fill), F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
    return F.concat(F.slice(a, 2, n), F.array(fill))


def with_terms(df: DataFrame, text: str, out: str = "terms") -> DataFrame:
    """Add ``out``: array of (f, n), the hashed words of ``text`` and their counts.

    Sorting the hashed words and measuring the runs stays inside the row.
    """
    hashed = df.withColumn("_f", F.sort_array(F.transform(tokens(F.col(text)), term)))
    pairs = F.arrays_zip(F.col("_f").alias("f"), _shift(F.col("_f"), 1, F.lit(-1).cast("long")).alias("p"))
    marked = hashed.withColumn("_n", F.size("_f")).withColumn(
        "_at",
        F.array_compact(
            F.transform(
                F.when(F.col("_n") > 0, pairs),
                lambda t, i: F.when(t["f"] != t["p"], F.struct(t["f"].alias("f"), i.alias("at"))),
            )
        ),
    )
    runs = F.arrays_zip(
        F.col("_at.f").alias("f"),
        F.col("_at.at").alias("at"),
        _shift(F.col("_at.at"), -1, F.col("_n")).alias("to"),
    )
    counted = F.transform(
        F.when(F.col("_n") > 0, runs),
        lambda t: F.struct(t["f"].alias("f"), (t["to"] - t["at"]).alias("n")),
    )
    none = F.expr("cast(array() as array<struct<f:bigint,n:int>>)")
    return marked.withColumn(out, F.coalesce(counted, none)).drop("_f", "_n", "_at")


class TermModel:
    """Document frequencies: at most ``SLOTS`` rows whatever the corpus.

    ``table`` has ``slot int, df bigint``; slot -1 holds the number of documents.
    """

    def __init__(self, table: DataFrame):
        self.table = table

    @cached_property
    def name(self) -> str:
        docs, slots, freq = self.frequencies
        return f"terms-{docs}-{zlib.crc32(slots.tobytes() + freq.tobytes()):08x}"

    def save(self, path: str) -> None:
        self.table.write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TermModel":
        return TermModel(spark.read.parquet(path))

    @cached_property
    def frequencies(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of documents, the used slots in order, and their frequencies."""
        rows = self.table.toArrow().sort_by("slot")
        slots = rows.column("slot").to_numpy().astype(np.int32)
        freq = rows.column("df").to_numpy().astype(np.int64)
        real = slots >= 0
        return int(freq[~real].sum()), slots[real], freq[real]

    @cached_property
    def shared(self):
        return self.table.sparkSession.sparkContext.broadcast(self.frequencies)


def fit(counted: DataFrame, terms: str = "terms") -> TermModel:
    """Count, per slot, the texts that use it; partial counts before the shuffle."""
    used = F.array_distinct(F.transform(F.col(terms)["f"], slot))
    ids = counted.select(
        F.explode_outer(F.concat(F.array(F.lit(DOC_COUNT_ROW)), used)).alias("slot")
    )
    return TermModel(ids.groupBy("slot").agg(F.count("*").alias("df")))


def frequency(flat: np.ndarray, slots: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Document frequency of every term, 0 for those the model never saw."""
    if len(slots) == 0:
        return np.zeros(len(flat), dtype=np.int64)
    want = (flat >> SLOT_SHIFT).astype(np.int32)
    at = np.minimum(np.searchsorted(slots, want), len(slots) - 1)
    return np.where(slots[at] == want, freq[at], 0)


def _weigher(model: TermModel, threshold: float):
    shared = model.shared

    floor = (threshold - min(HEAD_SLACK, threshold / 10)) ** 2

    @F.arrow_udf(f"struct<f:array<bigint>,w:array<double>,keys:array<{KEY_TYPE}>>")
    def weigh(f: pa.Array, n: pa.Array) -> pa.Array:
        docs, slots, freq = shared.value
        # Slices start at an offset, so lengths are taken from the list offsets.
        ends = f.offsets.to_numpy().astype(np.int64)
        flat = f.flatten().to_numpy(zero_copy_only=False)
        counts = n.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = ends - ends[0]
        sizes = np.diff(ends)
        row = np.repeat(np.arange(len(sizes)), sizes)
        seen = frequency(flat, slots, freq)
        w = counts * (np.log((docs + 1.0) / (seen + 1.0)) + 1.0)
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(sizes)))
        w = w / norm[row]
        rare_first = np.lexsort((flat, seen, row))
        # Squared length of everything from a term on, summed from the tail.
        mass = (w * w)[rare_first]
        tail = np.cumsum(mass[::-1])[::-1]
        rest = tail - np.append(tail, 0.0)[ends[1:]][row]
        head = rest >= floor
        head_row = row[head]
        head_sizes = np.bincount(head_row, minlength=len(sizes))
        head_ends = np.concatenate([[0], np.cumsum(head_sizes)])
        left_over = np.maximum((rest - mass)[head], 0.0)
        last = np.sqrt(np.maximum(left_over[np.maximum(head_ends[1:] - 1, 0)], 0.0)) if head.any() else rest
        keys = pa.StructArray.from_arrays(
            [
                pa.array(flat[rare_first][head], pa.int64()),
                pa.array(w[rare_first][head].astype(np.float32)),
                pa.array((1.0 - left_over).astype(np.float32)),
                pa.array(last[head_row].astype(np.float32)),
            ],
            names=["k", "w", "c", "r"],
        )
        offsets = pa.array(ends, pa.int32())
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(w, pa.float64())),
                pa.ListArray.from_arrays(pa.array(head_ends, pa.int32()), keys),
            ],
            names=["f", "w", "keys"],
        )

    return weigh


def embed(
    counted: DataFrame, model: TermModel, threshold: float, terms: str = "terms"
) -> DataFrame:
    """Replace ``terms`` by ``vec`` (unit length, ordered by term) and its ``keys``.

    One vector per text; a text without words gets the empty vector, which
    matches nothing.
    """
    weigh = _weigher(model, threshold)
    weighed = counted.withColumn("_v", weigh(F.col(terms)["f"], F.col(terms)["n"]))
    return weighed.select(
        *[c for c in counted.columns if c != terms],
        F.struct(F.col("_v")["f"].alias("f"), F.col("_v")["w"].alias("w")).alias("vec"),
        F.col("_v")["keys"].alias("keys"),
    )


def unit(vec: Column) -> Column:
    """Scale a dense vector to length one; a zero vector stays as it is.

    The vector and its length are bound to names of lambdas, or every element would make them again.
    """
    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
        return _bind(norm, lambda n: F.when(n > 0, F.transform(x, lambda e: e / n)).otherwise(x))

    return _bind(F.transform(vec, lambda x: x.cast("double")), scaled)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_dot(df: DataFrame, a: str, b: str, out: str = "sim") -> DataFrame:
    """Add the dot product of two term vectors.

    Both are ordered by term, so sorting their concatenation is one merge of two
    runs, and equal neighbours are the shared terms.
    """
    def terms(c: str) -> Column:
        return F.arrays_zip(F.col(f"{c}.f").alias("f"), F.col(f"{c}.w").alias("w"))

    merged = F.sort_array(F.concat(terms(a), terms(b)))
    walked = F.aggregate(
        merged,
        F.struct(F.lit(0.0).alias("s"), F.lit(-1).cast("long").alias("f"), F.lit(0.0).alias("w")),
        lambda acc, t: F.struct(
            (acc["s"] + F.when(acc["f"] == t["f"], acc["w"] * t["w"]).otherwise(0.0)).alias("s"),
            t["f"].alias("f"),
            t["w"].alias("w"),
        ),
    )
    return df.withColumn(out, walked["s"])
