"""Quality by a document classifier and hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import common as C
from tidewire.llm.learning import logistic, sample
from tidewire.session import cut

# Labelled documents of each class that the classifier is fitted on, at most.
PER_CLASS = 5000
FEATURES = 14

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_BYTES, list(b".,;:?"))
_CALL = _BYTES == ord("!")
_BAR = _BYTES == ord("|")
_SYMBOL = np.isin(_BYTES, list(b"#*$%&<>@^~=_+{}[]\\/"))
_GROUPS = np.array([_UPPER, _LOWER, _DIGIT, _STOP, _CALL, _BAR, _SYMBOL, _BYTES >= 128]).T.astype(float)


def features(text: str) -> np.ndarray:
    """Shares of kinds of characters and words of a whole text; zeros if it has no words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    out = np.zeros(FEATURES)
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = counts[~_SPACE].sum()
    n = len(words)
    out[:8] = counts @ _GROUPS / solid
    out[4:7] = np.minimum(out[4:7] * 5, 1)
    out[8] = min(solid / n, 30) / 10
    out[9] = len(set(words)) / n
    out[10] = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[11] = 1 - len(set(lines)) / max(len(lines), 1)
    out[12] = min(math.log(n), 8) / 8
    out[13] = min(n / max(len(lines), 1), 100) / 100
    return out


class Classifier:
    """A logistic model of the features; the odds are those of all labels, not of the sample."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, shift: float):
        self.mean, self.scale, self.beta, self.shift = mean, scale, beta, shift

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.beta[:-1] + self.beta[-1] + self.shift, -12, 12)


def _featured(df: DataFrame, text: str) -> DataFrame:
    frame = df.select(C.packed(df), C.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(x, pa.list_(pa.float64()))], names=["row", "x"]
            )

    kind = T.StructType([frame.schema["row"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return frame.mapInArrow(run, kind)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """Fitted on at most ``PER_CLASS`` labelled documents of each class; these few rows of
    ``FEATURES`` numbers are all that the driver gets."""
    chosen, counts = sample(labels, label, PER_CLASS)
    frame = docs.select(C.col(doc_id).cast("long").alias("doc_id"), C.col(text).alias("text"))
    few = frame.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = _featured(few, "text").select("row.doc_id", "row.y", "x").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        flat = 4.0 if not len(y) or y[0] else -4.0
        return Classifier(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), flat)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = logistic(np.clip((x - mean) / scale, -8, 8), y, balance)
    odds = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    return Classifier(mean, scale, beta, odds)


def scored(df: DataFrame, text: str, model: Classifier, site: Column) -> DataFrame:
    """(row, site, p): the classifier's probability that the text is good; null without words."""
    frame = df.select(C.packed(df), site.alias("site"), C.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-model.log_odds(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("site"), pa.array(p, mask=~x.any(axis=1))],
                names=["row", "site", "p"],
            )

    kind = T.StructType([frame.schema["row"], frame.schema["site"], T.StructField("p", T.DoubleType())])
    return frame.mapInArrow(run, kind)


def _strength(groups: DataFrame, by: str) -> float:
    """How many documents the mean of all weighs as much as, against a group's own mean.

    By moments: what the group means vary beyond what their sizes explain is the variance between.
    """
    r = groups.agg(
        F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("n") * F.col(by)).alias("m"), F.sum(F.col("n") * F.col(by) * F.col(by)).alias("v"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(by)) ** 2).alias("b"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    n = r["n"] or 0
    if n < 2 or r["h"] < 2:
        return 50.0
    mean = r["s"] / n
    within = max(r["q"] / n - mean * mean, 1e-9)
    between = (r["b"] - (r["h"] - 1) * within) / max(n - r["nn"] / n, 1e-9)
    return float(min(max(within / max(between, 1e-9), 5.0), 10_000.0))


def posteriors(scores: DataFrame) -> tuple[DataFrame, float, int]:
    """From (host, path, p): (site, host_rate, site_rate, n) per host and path; the global rate.

    A host's rate is its mean evidence shrunk to the global rate, a path's is its own shrunk to
    its host's, each by a strength estimated from how groups differ.  Both are grouped sums, so a
    host of any size is added up in all tasks.
    """
    site = scores.where("p is not null").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")
    )
    host = site.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    total = host.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n = total["n"] or 0
    rate = min(max((total["s"] + 1) / (n + 2), 1e-4), 1 - 1e-4) if n else 0.5
    k = _strength(host.withColumn("g", F.lit(rate)), "g")
    rates = host.select("host", ((F.col("s") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    joined = site.withColumnRenamed("host", "h").join(rates, F.col("h").eqNullSafe(F.col("host"))).drop("h")
    kp = _strength(joined, "host_rate")
    site_rate = (F.col("s") + kp * F.col("host_rate")) / (F.col("n") + kp)
    return joined.select(site_key(F.col("host"), F.col("path")).alias("site"), "host_rate", site_rate.alias("site_rate"), "n"), rate, n


def site_key(host: Column, path: Column) -> Column:
    """One string for a host and path; null differs from every text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.regexp_replace(c, "\t", "\t\t")), F.lit("-"))
    return F.concat(part(host), F.lit("\t/"), part(path))


def judge(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5
) -> DataFrame:
    """(row, p, host_rate, site_rate, score, kept) for every row of ``docs``.

    ``score`` is the posterior that the document is good: the classifier's odds times the odds of
    its path over those of all documents.  ``kept``: the score is at least ``threshold``.

    Texts without words, null ones among them, have score 0 and go.  Null hosts and paths are
    sites of their own.  Equal rows are judged alike.  Without labels of both classes the
    classifier is constant.  Texts are read twice (once for the sites' sums) and never shuffled,
    unless there are more sites than a lookup table may have; then hot sites still aren't.
    """
    model = fit(docs, labels, doc_id, text)
    where = docs.select(host.alias("host"), path.alias("path"), C.col(text).alias("text"))
    seen = scored(where, "text", model, F.lit("")).select("row.host", "row.path", "p")
    sites, rate, n = posteriors(cut(seen, "quality-seen"))
    sites = cut(sites, "quality-sites")
    found = C.attach(scored(docs, text, model, site_key(host, path)), sites, "site", "n", n)
    logit = lambda c: F.log(c / (1 - c))
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = logit(F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))) + logit(bound(F.col("site_rate"))) - math.log(rate / (1 - rate))
    score = F.coalesce(1 / (1 + F.exp(-odds)), F.lit(0.0))
    return found.select(
        "row", "p", "host_rate", "site_rate", score.alias("score"), (score >= threshold).alias("kept")
    )
