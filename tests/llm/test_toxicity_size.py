"""What a toxicity worker holds."""

from __future__ import annotations

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from tidewire.llm import toxicity


def test_terms_of_odd_texts():
    """Texts cut at ASCII marks have the terms of their tokens, as a slice of a batch too."""
    texts = [
        "Haus's don't ΑΣ'Α ΟΔΟΣ. İstanbul x²y a1b2 a_b Straße\x1cx naïve", None, "", " !! ", "日本語テスト，中文 abcdefgh",
        "nbsp\xa0word—dash\x85z ½ ٣ab٤c",
    ]
    names = {}
    for w in [w for t in texts for w in toxicity.tokens(t)]:
        for p in toxicity.parts(w):
            names.setdefault(p, len(names))
    known = toxicity.Kept(names)
    for text, found in zip(texts, known.terms(pa.array(["x", *texts], pa.string()).slice(1)), strict=True):
        assert sorted(found.tolist()) == sorted(names[p] for w in toxicity.tokens(text) for p in toxicity.parts(w))
    assert known.flat.itemsize == known.ends.itemsize == 4


def test_packed_numbers():
    for x in ([], [0], [255] * 200, [256, 1], [1 << 24, 0, 7], [2**32 - 1]):
        packed = toxicity.planes(np.array(x, np.int64))
        assert toxicity.unplanes(packed).tolist() == x
        assert len(packed) == 1 + len(x) * max(1, -(-max(x, default=0).bit_length() // 8))


def test_index_is_unpacked_without_more_of_its_size():
    rng = np.random.default_rng(1)
    examples = [(i, i % 2, np.sort(rng.choice(40_000, 1500, replace=False)), np.ones(1500, np.int32)) for i in range(400)]
    whole = toxicity.Index(rng.random(40_000) + 0.5, examples, {0: 200, 1: 200})
    packed = pickle.dumps(whole)
    tracemalloc.start()
    index = pickle.loads(packed)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 1.6 * held and held < 16 * 400 * 1500
    asked = [whole.vector(*x[2:]) for x in examples[:20]]
    for (a, x), (b, y) in zip(whole.several(asked), index.several(asked), strict=True):
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_index_is_made_without_sorting_its_postings():
    rng = np.random.default_rng(2)
    examples = [(i, i % 2, np.sort(rng.choice(40_000, 1500, replace=False)), np.ones(1500, np.uint8)) for i in range(400)]
    tracemalloc.start()
    index = toxicity.Index(rng.random(40_000) + 0.5, examples, {0: 200, 1: 200})
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 50 * 400 * 1500
    for e in (0, 7, 399):
        mine = np.flatnonzero(index.example == e)
        want = next(x for x in examples if x[0] == index.ids[e])
        assert (np.searchsorted(index.begin, mine, "right") - 1).tolist() == want[2].tolist()


def test_driver_gets_numbers_of_examples(spark, monkeypatch):
    """Of the examples' terms the driver gets every name once and packed numbers, not all names of each."""
    got, taken = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (got.append(t := taken(self)), t)[1])
    words = ["".join(chr(97 + (k // 26**j) % 26) for j in range(3)) + "word" for k in range(600)]
    rows = [(i, " ".join(words[(i * 7 + k) % 600] for k in range(300))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    scored = toxicity.score(df, labels)
    postings = 240 * 300 * 4
    assert sum(t.nbytes for t in got) < 4 * postings
    assert scored.count() == 300
