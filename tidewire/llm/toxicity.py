"""Toxicity by the nearest labelled examples, found in a block-max inverted index."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import common as C
from tidewire.llm.learning import logistic, sample
from tidewire.session import cut

# Labelled examples of each class in the index, at most.
PER_CLASS = 4000
# A log-likelihood ratio that adds to a term's weight (chance alone gives 20 once in 130,000 terms).
LEAST_G2 = 20.0
NEIGHBOURS = 25
BLOCK = 32
# The terms by which examples are sorted into blocks.
LEADING = 8
# Blocks that are scored before the others are held against what they give.
FIRST_BLOCKS = 4
# The commonest terms, whose weights are also held as a dense matrix, and vectors scored against it at once.
DENSE = 1024
TOGETHER = 128
# By how much cosines in single precision may be off: as many products are added up, of weights
# that aren't negative and cosines of 1 at most.
MARGIN = (DENSE + 8) * 2.0**-24
# Examples whose vote without themselves calibrates the score, at most.
CALIBRATED = 1000
# Weight of the prior among the votes.
PRIOR_WEIGHT = 0.5
# Scored vectors that a worker remembers by digest; when there are more, it starts anew.
CACHE = 50_000
# Words whose terms a worker remembers, likewise.
CACHE_WORDS = 250_000
# Rows whose packed terms are handed on at once.
HANDED_ON = 500

TOKEN = re.compile(r"[^\W\d_]+")
# A space for every ASCII character that isn't a letter.
SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def parts(word: str) -> list[str]:
    """The terms of a word: itself, and its beginnings of four to six letters for what it may be
    compounded of."""
    return [word, *(word[:k] + "~" for k in (4, 5, 6) if len(word) > k)]


class Kept(dict):
    """A number for every piece of text without ASCII marks, digits and spaces, and by it the numbers of
    the terms in it, as far as they are kept.  The terms are held in arrays, which take four bytes each."""

    def __init__(self, keep: dict[str, int]):
        self.keep = keep
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.flat, self.ends = array("i"), array("i", [0])

    def __missing__(self, piece: str) -> int:
        get, add = self.keep.get, self.flat.append
        for word in (piece,) if piece.isalpha() else TOKEN.findall(piece):
            n = len(word)
            if n > 4:
                first = get(word[:4] + "~")
                if first is None:
                    # An example's term that is longer than this beginning comes with it.
                    continue
                add(first)
                for k in (5, 6):
                    if n > k and (found := get(word[:k] + "~")) is not None:
                        add(found)
            if (found := get(word)) is not None:
                add(found)
        self.ends.append(len(self.flat))
        self[piece] = number = len(self.ends) - 2
        return number

    def terms(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The numbers of the terms of each text's tokens, one after the other.

        A token's ASCII characters are letters.  So texts are cut at all others, and each different piece is looked up once.
        """
        if len(self) >= CACHE_WORDS:
            self.empty()
        lowered = [t.lower().encode().translate(SPACED) if t else b"" for t in texts.to_pylist()]
        pieces = pc.ascii_split_whitespace(pa.array(lowered, pa.string()))
        coded = pieces.flatten().dictionary_encode()
        number = np.array([self[x] for x in coded.dictionary.to_numpy(zero_copy_only=False)], np.int64)
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        words = number[coded.indices.to_numpy(zero_copy_only=False)]
        split = np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        for w in np.split(words, split):
            at, _ = runs(ends[w], ends[w + 1])
            yield flat[at]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each ``first`` to before its ``last``, one run after the other; the runs' lengths."""
    many = last - first
    ends = np.cumsum(many)
    out = np.repeat(first - ends + many, many)
    out += np.arange(len(out))
    return out, many


class Index:
    """Postings of the examples in blocks of 32, with every block's largest weight of each term.

    The largest score that a block can reach is the sum of its largest weights; the blocks of the
    largest bounds are scored first, then those that can beat the neighbours found.  So the search
    is exact.  Cells (a term in a block) are held only where there are postings.

    Long texts share their common words with most blocks, so that few are left out.  ``several``
    finds the same neighbours of many vectors at once, without bounds: the commonest terms by one
    matrix product in single precision, all others by their postings; what may be among the nearest
    by that is computed again in double precision.
    """

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]], counts: dict[int, int]):
        """``examples``: (id, label, terms, frequencies); ``counts``: all labelled rows by class."""
        self.idf = idf
        # Examples with the same leading terms share blocks, which keeps the bounds tight.
        keys = []
        for k, (i, _, terms, n) in enumerate(examples):
            t, w = self.vector(terms, n)
            keys.append((t[np.lexsort((t, -w))[:LEADING]].tolist(), i, k))
        examples = [examples[k] for _, _, k in sorted(keys)]
        del keys
        self.ids = np.array([x[0] for x in examples], np.int64)
        self.y = np.array([x[1] for x in examples], float)
        sampled = Counter(self.y.tolist())
        self.importance = np.array([counts.get(int(y), 1) / sampled[y] for y in self.y])
        self.prior = min(max((counts.get(1, 0) + 1) / (sum(counts.values()) + 2), 0.001), 0.999)
        self.blocks = -(-len(examples) // BLOCK)
        sizes = [len(x[2]) for x in examples]
        held = np.zeros(len(idf), np.int64)
        for x in examples:
            held[x[2]] += 1
        self.begin = np.concatenate([[0], np.cumsum(held)])
        # Each example's postings go behind those before it, so that nothing of all postings' size is sorted.
        self.example = np.empty(self.begin[-1], np.int32)
        most = max((int(np.max(x[3], initial=0)) for x in examples), default=0)
        self.count = np.empty(self.begin[-1], np.min_scalar_type(most))
        free = self.begin[:-1].copy()
        for e, x in enumerate(examples):
            at = free[x[2]]
            self.example[at], self.count[at] = e, x[3]
            free[x[2]] += 1
        del free, held
        self.norm = np.array([self.length(x[2], x[3]) for x in examples])
        self.weight = self.weights()
        block = self.example // BLOCK
        new = np.ones(len(block) + 1, bool)
        np.not_equal(block[1:], block[:-1], out=new[1:-1])
        new[self.begin] = True
        first = np.flatnonzero(new[:-1])
        self.first = np.append(first, len(block))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block = block[first]
        self.cells = np.searchsorted(first, self.begin)
        del block, new, first
        self.empty = self.prior
        bare = np.array([not n for n in sizes], bool)
        if bare.any():
            w = self.importance[bare]
            self.empty = float((w @ self.y[bare] + self.prior) / (w.sum() + 1))
        self.slope, self.shift = 1.0, 0.0
        tried = np.flatnonzero(~bare)
        tried = tried[:: max(1, -(-len(tried) // CALIBRATED))]
        if len(tried) and 0 < self.y[tried].mean() < 1:
            votes = np.array([self.vote(*self.vector(*examples[e][2:]), skip=e)[0] for e in tried])
            weight = self.importance[tried] / self.importance[tried].mean()
            self.slope, self.shift = logistic(np.log(votes / (1 - votes))[:, None], self.y[tried], weight, ridge=0.1)

    def __getstate__(self) -> dict:
        """What ``score`` needs: tasks get counts, not weights, and no bounds."""
        left_out = ("weight", "first", "most", "block", "cells", "logs", "dense")
        out = {k: v for k, v in self.__dict__.items() if k not in left_out}
        return out | {"example": self.example.astype(np.min_scalar_type(max(len(self.ids), 1)))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.weight = self.weights()

    def weights(self, step: int = 1 << 16) -> np.ndarray:
        """Of the postings; made a part at a time, so that nothing else as large is held."""
        out = np.empty(len(self.example))
        for k in range(0, len(out), step):
            at = slice(k, min(k + step, len(out)))
            first, last = np.searchsorted(self.begin, k, "right") - 1, np.searchsorted(self.begin, at.stop)
            many = np.diff(np.clip(self.begin[first : last + 1], k, at.stop))
            out[at] = self.logs[self.count[at]] * np.repeat(self.idf[first:last], many) / self.norm[self.example[at]]
        return out

    @cached_property
    def logs(self) -> np.ndarray:
        """What a count gives to the weight, by count."""
        counts = np.arange(int(self.count.max(initial=0)) + 1, dtype=float)
        return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)

    def raw(self, terms: list[int], counts: list[int]) -> np.ndarray:
        return (1 + np.log(np.asarray(counts, float))) * self.idf[np.asarray(terms, np.int32)]

    def length(self, terms: list[int], counts: list[int]) -> float:
        w = self.raw(terms, counts)
        return max(math.sqrt(float(w @ w)), 1e-12)

    def vector(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        w = self.raw(terms, counts)
        return np.asarray(terms, np.int32), w / max(math.sqrt(float(w @ w)), 1e-12)

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The examples of largest cosine, equal ones by their place, and the cosines."""
        cell, many = runs(self.cells[t], self.cells[t + 1])
        w = np.repeat(w, many)
        block = self.block[cell]
        bound = np.bincount(block, self.most[cell] * w, self.blocks)
        left = bound > 0
        chosen = np.zeros(self.blocks, bool)
        chosen[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        got, scores = np.zeros(0, np.int64), np.zeros(0)
        while (chosen := chosen & left).any():
            mine = chosen[block]
            at, many = runs(self.first[cell[mine]], self.first[cell[mine] + 1])
            total = np.bincount(self.example[at], self.weight[at] * np.repeat(w[mine], many), len(self.ids))
            if skip >= 0:
                total[skip] = 0
            ex = np.flatnonzero(total > 0)
            got, scores = np.concatenate([got, ex]), np.concatenate([scores, total[ex]])
            best = np.lexsort((got, -np.round(scores, 12)))[:NEIGHBOURS]
            got, scores = got[best], scores[best]
            left &= ~chosen
            chosen = bound >= scores[-1] - 1e-9 if len(got) == NEIGHBOURS else left
        return got, scores

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row of each common term (-1 of others), and by example their weights, in single precision, and counts."""
        begin, many = self.begin, np.diff(self.begin)
        common = np.argsort(-many, kind="stable")[:DENSE]
        row = np.full(len(many), -1, np.int32)
        row[common] = np.arange(len(common))
        out = np.zeros((len(common), len(self.ids)), np.float32)
        counts = np.zeros(out.shape[::-1], self.count.dtype)
        for r, t in enumerate(common):
            at = slice(begin[t], begin[t + 1])
            counts[self.example[at], r] = self.count[at]
            out[r, self.example[at]] = self.logs[self.count[at]] * self.idf[t] / self.norm[self.example[at]]
        return row, out, counts

    def several(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector what ``nearest`` gives."""
        row, matrix, counts = self.dense
        idf = np.zeros(len(matrix))
        idf[row[row >= 0]] = self.idf[row >= 0]
        for k in range(0, len(vectors), TOGETHER):
            part = vectors[k : k + TOGETHER]
            common = np.zeros((len(part), len(matrix)))
            for x, (t, w) in zip(common, part, strict=True):
                held = row[t] >= 0
                x[row[t[held]]] = w[held]
            for sums, x, (t, w) in zip(common.astype(np.float32) @ matrix, common * idf, part, strict=True):
                rare = row[t] < 0
                at, many = runs(self.begin[t[rare]], self.begin[t[rare] + 1])
                # No place is out of bounds; without a check they are read faster.
                weight = self.weight.take(at, mode="clip")
                weight *= np.repeat(w[rare], many)
                total = np.bincount(self.example.take(at, mode="clip"), weight, len(sums))
                near = total + sums
                least = np.partition(near, -NEIGHBOURS)[-NEIGHBOURS] if len(near) > NEIGHBOURS else 0
                # What is off by the margin at most can't be beaten by what is twice as far below.
                ex = np.flatnonzero((near >= least - 2 * MARGIN - 1e-9) & (near > 0))
                total = total[ex] + self.logs[counts[ex]] @ x / self.norm[ex]
                best = np.lexsort((ex, -np.round(total, 12)))[:NEIGHBOURS]
                yield ex[best], total[best]

    def vote(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray]:
        """The share of label 1 among the neighbours, each weighed by its squared cosine."""
        return self.share(*self.nearest(t, w, skip))

    def share(self, near: np.ndarray, cosine: np.ndarray) -> tuple[float, np.ndarray]:
        weight = cosine * cosine * self.importance[near]
        unit = PRIOR_WEIGHT
        share = (weight @ self.y[near] + unit * self.prior) / (weight.sum() + unit)
        return min(max(float(share), 1e-6), 1 - 1e-6), near

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """The calibrated score of each (terms, counts), and the ids of the nearest examples as evidence."""
        out = [(self.empty, [])] * len(vectors)
        some = [k for k, (t, _) in enumerate(vectors) if len(t)]
        for k, found in zip(some, self.several([self.vector(*vectors[k]) for k in some]), strict=True):
            vote, near = self.share(*found)
            z = self.slope * math.log(vote / (1 - vote)) + self.shift
            out[k] = 1 / (1 + math.exp(-min(max(z, -30), 30))), self.ids[near[:5]].tolist()
        return out


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 by their bytes, all lowest ones first, as many as the largest has; a byte tells how many."""
    many = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([many]) + np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4)[:, :many].T.tobytes()


def unplanes(x: bytes) -> np.ndarray:
    out = np.zeros(((len(x) - 1) // x[0], 4), np.uint8)
    out[:, : x[0]] = np.frombuffer(x, np.uint8, offset=1).reshape(x[0], -1).T
    return out.view("<u4").ravel().astype(np.int64)


def _vocabulary(df: DataFrame) -> pa.Table:
    """(term, n): all terms of the texts and how many have them, the commonest first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update({x for w in set(tokens(text.as_py())) for x in parts(w)})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"]
        )

    counted = df.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.toArrow().sort_by([("n", "descending"), ("term", "ascending")])


def _numbers_of(df: DataFrame, keep: dict[str, int]) -> DataFrame:
    """(row, terms, counts) of (row, text): the numbers of the kept terms, as steps, and their counts, packed.

    A worker holds the kept terms once, and of the packed ones those of a few rows.
    """
    kind = T.StructType(
        [df.schema["row"], T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    )
    shared = df.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Kept(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, HANDED_ON):
                batch = whole.slice(at, HANDED_ON)
                terms, counts = [], []
                for found in known.terms(batch.column("text")):
                    number, n = np.unique(found, return_counts=True)
                    terms.append(planes(np.diff(number, prepend=0)))
                    counts.append(planes(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                    names=["row", "terms", "counts"],
                )

    return df.mapInArrow(run, kind)


def _having(found: DataFrame, size: int) -> np.ndarray:
    """In how many rows each of ``size`` terms is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                having[np.cumsum(unplanes(terms.as_py()))] += 1
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(having[some])], names=["term", "n"])

    counted = found.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    out = np.zeros(size, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def telling(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How well terms tell the classes apart: the root of the log-likelihood ratio, 1 where it may be chance.

    ``a`` of the ``n1`` examples and ``b`` of the ``n0`` have the term.
    """
    if not n1 or not n0:
        return np.ones(len(a))

    def part(x, n, both):
        return np.where(x > 0, x * np.log(np.maximum(x, 1) * (n1 + n0) / (n * np.maximum(both, 1))), 0.0)

    both = a + b
    none = n1 + n0 - both
    g2 = 2 * (part(a, n1, both) + part(b, n0, both) + part(n1 - a, n1, none) + part(n0 - b, n0, none))
    return np.where(g2 >= LEAST_G2, np.sqrt(np.maximum(g2, 1)), 1.0)


def score(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(row, score, evidence) of every row of ``df``; ``row`` has all its columns but the text.

    At most ``PER_CLASS`` labelled documents of each class, none of them held out, are the
    examples; the bounded index of all their terms is what tasks get.  Terms are weighed by TF-IDF
    with document frequencies over all documents, times how well they tell the classes apart (1 or
    more, so none is left out).  Other terms of a document are in no example and change no order
    of its neighbours.  ``score`` is the calibrated vote of the nearest examples by exact cosine,
    ``evidence`` the ids of the first five.

    A text without terms of the examples, as an empty or null one, gets the rate of examples
    without terms.  Equal texts have equal scores.  With one class alone every score is the
    smoothed rate.  Texts are read twice (examples, all) and never shuffled.
    """
    chosen, counts = sample(labels, label, PER_CLASS)
    texts = df.select(C.col(doc_id).cast("long").alias("doc_id"), C.col(text).alias("text"))
    few = cut(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-examples")
    # Terms are numbered by how many examples have them; the driver gets their names once, and numbers of examples.
    keep = {term: i for i, term in enumerate(_vocabulary(few)["term"].to_pylist())}
    size = len(keep)
    found = cut(
        _numbers_of(df.select(C.packed(df.drop(text)), C.col(text).alias("text")), keep), "toxicity-terms"
    )
    examples = cut(_numbers_of(few.select(C.packed(few.drop("text")), "text"), keep), "toxicity-numbers")
    del keep
    having = _having(found, size)
    vectors, of = [], np.zeros((2, size), np.int64)
    for row in examples.select("row.doc_id", "row.y", "terms", "counts").toArrow().sort_by("doc_id").to_batches(1000):
        for i, y, terms, counted in zip(*(column.to_pylist() for column in row.columns), strict=True):
            number, n = np.cumsum(unplanes(terms)).astype(np.int32), unplanes(counted)
            of[y, number] += 1
            vectors.append((i, y, number, n.astype(np.min_scalar_type(n.max(initial=0)))))
    sizes = Counter(y for _, y, _, _ in vectors)
    idf = np.log((found.count() + 1) / (having + 1)) + 1
    weight = idf * telling(of[1], of[0], sizes.get(1, 0), sizes.get(0, 0))
    index = Index(weight, vectors, {y: counts[y] for y in sizes})
    del vectors
    # Not by the closure, which every task would unpack anew beside the one before it.
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known: dict[bytes, tuple[float, list[int]]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                terms, counts = batch.column("terms").to_pylist(), batch.column("counts").to_pylist()
                keys = [xxhash.xxh3_128_digest(t + n) for t, n in zip(terms, counts, strict=True)]
                if len(known) >= CACHE:
                    known.clear()
                fresh = {x: i for i, x in enumerate(keys) if x not in known}
                pairs = [(np.cumsum(unplanes(terms[i])), unplanes(counts[i])) for i in fresh.values()]
                known.update(zip(fresh, index.score(pairs), strict=True))
                got = [known[x] for x in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        pa.array([g[0] for g in got], pa.float64()),
                        pa.array([g[1] for g in got], pa.list_(pa.int64())),
                    ],
                    names=["row", "score", "evidence"],
                )

    kind = T.StructType(
        [found.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))]
    )
    return found.mapInArrow(run, kind)
