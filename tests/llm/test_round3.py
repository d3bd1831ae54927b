"""Repeated strings, whitening and the Merkle manifest against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import merkle, queries, repeats, whitening

COLUMNS = "doc_id long, text string, source string, lang string, n_chars long, a int, t string, kept string, row int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(bodies, ids=None):
    ids = range(len(bodies)) if ids is None else ids
    return [(i, b, f"s{(i or 0) % 3}", "en", len(b or ""), 1, "x", "y", 2) for i, b in zip(ids, bodies, strict=True)]


@pytest.fixture(scope="module")
def bodies():
    """Shared passages at odd places, copies, runs of one letter, letters of several bytes, nulls."""
    rng = random.Random(4)
    letters = "abcdefgh éü\n"
    def free(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [free(n) for n in (90, 99, 100, 101, 160, 400, 1500)]
    out = [None, "", " ", "short", "x" * 99, "x" * 100, "x" * 350, "ab" * 300]
    for _ in range(60):
        parts = [free(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(passages), free(rng.randint(0, 120))]
        out.append("".join(parts))
    return out + [out[20], out[21] + "!", passages[-1] * 8]


def brute_repeats(rows, length):
    """(key, n_bytes, n_removed, n_spans, sha) in the order of documents."""
    seen, out = set(), {}
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        left = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "crowd"), [(100, 40, 1024), (100, 40, 3), (24, 9, 2), (100, 70, 1)])
def test_repeats_equal_brute_force(spark, bodies, length, gram, crowd):
    df = spark.createDataFrame(rows_of(bodies), COLUMNS).repartition(5)
    got = repeats.remove_repeats(df, length=length, gram=gram, crowd=crowd)
    assert got.columns == ["row", "n_bytes", "spans", "kept"]
    got = {
        r["row"]["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in got.collect()
    }
    assert got == brute_repeats(enumerate(bodies), length)


def test_repeats_of_odd_ids(spark, bodies):
    long = [b for b in bodies if b and len(b) > 300]
    df = spark.createDataFrame(
        rows_of([long[0], long[0], long[1], long[0], long[1], long[2]], [7, 7, 8, 9, None, None]), COLUMNS
    )
    got = [(r["row"]["doc_id"], len(r["kept"]), r["n_bytes"]) for r in repeats.remove_repeats(df).collect()]
    assert [x for x in got if x[0] == 7] == 2 * [(7, got[0][2], got[0][2])] or len({x for x in got if x[0] == 7}) == 1
    assert [x[1] for x in got if x[0] == 9] == [0] and (None, 0, len(long[1].encode())) in got
    assert repeats.remove_repeats(df.where("false")).count() == 0


def test_colliding_hashes_are_found(bodies, monkeypatch):
    """With a hash that says that all is equal the bytes decide."""
    flat = np.frombuffer("".join(b for b in bodies if b).encode()[:6000], np.uint8)
    at = np.random.default_rng(2).integers(0, 1000, 300)
    group = np.arange(300) % 2

    def sorted_keys():
        order, common = repeats.suffix_sort(repeats.Prefixes(flat), at, group, 50)
        keys = [(group[i], flat[at[i] : at[i] + 50].tobytes()) for i in order]
        assert keys == sorted(keys)
        for (g, x), (k, y), n in zip(keys[:-1], keys[1:], common[1:], strict=True):
            assert n == (-1 if g != k else next((i for i in range(50) if x[i] != y[i]), 50))
        return keys

    keys = sorted_keys()
    monkeypatch.setattr(repeats.Prefixes, "extension", lambda self, x, y, most: np.full(len(x), most))
    assert repeats.proven(repeats.Prefixes(flat), at, group * 0, 50) is None
    assert sorted_keys() == keys


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 105, 400).astype(np.uint8)
    docs = [np.concatenate([rng.integers(97, 105, n).astype(np.uint8), passage]) for n in (0, 37, 2000)]
    ends = np.cumsum([0] + [len(d) for d in docs])
    at, g = repeats.anchors(np.concatenate(docs), ends, 100, 40)
    inside = []
    for d, e in zip(docs, ends[1:], strict=True):
        here = (at >= e - 300) & (at <= e - 100)
        inside.append(list(zip((at[here] - e).tolist(), g[here].tolist())))
    assert inside[0] and inside[0] == inside[1] == inside[2]
    gaps = np.diff(at[(at >= ends[2]) & (at < ends[3])])
    assert gaps.max() <= 61


# Whitening


def vectors(seed=3, n=400, dims=6):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims))).round(3)


def brute_whitening(x, count=4):
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    d = [[int(n) * int(v) - int(s) for v, s in zip(row, sums, strict=True)] for row in u.tolist()]
    dims = x.shape[1]
    cov = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(dims)] for i in range(dims)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    dev = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return n, dev, ((x * n - sums) / n) @ v[:, :count] / np.sqrt(e[:count]), e[:count] / np.trace(cov)


def test_whitening(spark):
    body = vectors()
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(body)] + [(1000, body[3].tolist(), "x", 1)] * 2
    inf, nan = float("inf"), float("nan")
    bad = [None, [None] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, nan], [inf, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0, 2.0], []]
    df = spark.createDataFrame(
        rows + [(2000 + i, v, "x", 1) for i, v in enumerate(bad)], "id long, v array<double>, component string, row int"
    ).repartition(4)
    got = whitening.whiten(df, "v").select("row.id", *whitening.whiten(df, "v").columns[1:]).toPandas()
    assert len(got) == 4 * 402 and got["id"].max() == 1000
    x = np.floor(body * 256).astype(np.int64)
    n, dev, w, share = brute_whitening(x)
    whole = got[got["id"] < 1000].pivot(index="id", columns="component")
    assert (got["n"] == n).all() and [int(v) for v in whole["deviation"][1]] == dev
    sign = np.sign(w[0] * whole["whitened"].to_numpy()[0])
    assert np.allclose(whole["whitened"].to_numpy() * sign, w, atol=1e-8)
    assert np.allclose(whole["explained"].to_numpy(), share) and (got["identity_error"] < 1e-9).all()


def test_whitening_without_variance(spark):
    schema = "id long, v array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema), "v").count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema), "v").collect()
    assert len(one) == 4 and {(r["whitened"], r["explained"], int(r["deviation"])) for r in one} == {(None, 0.0, 0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, -0.0]) for i in range(5)], schema)
    got = whitening.whiten(line, "v").collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and len(got) == 15
    assert max(r["identity_error"] for r in got) < 1e-12


def test_sums_of_any_size_are_exact():
    rng = np.random.default_rng(5)
    for top in (10, 1 << 23, 1 << 40, 1 << 59):
        s = rng.integers(-top, top, (5000, 3))
        want = [sum(int(x) ** 2 for x in column) for column in s.T]
        assert whitening.square_sums(s) == want == whitening.square_sums(s.astype(object))
    big = np.array([[1 << 62, -5], [3, 1 << 61]])
    assert whitening.centred(big, 1000, [7, 8]).tolist() == [[1000 * (1 << 62) - 7, -5008], [2993, 1000 * (1 << 61) - 8]]
    total = [10**30, -(10**25), 0, 5]
    back = [0] * 4
    for at, limb, value in (x for i, v in enumerate(total) for x in whitening.limbs(i, v)):
        back[at] += value << (whitening.LIMB * limb)
    assert back == total


# Manifest


def framed(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        b = levels[-1]
        levels.append([sha("".join(b[i : i + fanout])) for i in range(0, len(b), fanout)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            at = i - i % fanout
            path.append([None if at + k == i else d for k, d in enumerate(level[at : at + fanout])])
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows, fanout):
    """rows of (source, doc_id, leaf) to (source, doc_id, leaf, subroot, root, proof)."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in groups:
        part = sorted(by[s], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        made.append((part, *tree([r[2] for r in part], fanout)))
    root, above = tree([m[1] for m in made], fanout)
    return [
        (*r, sub, root, path + top)
        for (part, sub, paths), top in zip(made, above, strict=True)
        for r, path in zip(part, paths, strict=True)
    ]


@pytest.mark.parametrize(("height", "fanout"), [(7, 3), (1, 3), (2, 2), (0, 3)])
def test_manifest(spark, height, fanout):
    """Partitions of a few leaves, so that several rounds are swapped; ties, nulls and odd names."""
    rng = random.Random(9)
    sizes = {None: 4, "": 1, "a": 1, "b": 2, "é": 30, "z": 121, "Z": 27, "=": 82, "a'": 10}
    rows = [(s, rng.randint(0, 150), f"{s} {rng.random()}") for s, n in sizes.items() for _ in range(n)]
    rows += [("z", None, "no id"), ("z", 5, "same"), ("z", 5, "same")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "source string, doc_id long, text string, row int, root string")
    leaves = df.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text"))).repartition(4)
    out = merkle.manifest(leaves, "source", "doc_id", "leaf", fanout, height)
    got = [
        (r["s"], r["d"], r["leaf"], r["subroot"], r["root"], r["proof"], r["f"])
        for r in out.select(
            F.col("row.source").alias("s"), F.col("row.doc_id").alias("d"), "leaf", "subroot", "root", "proof",
            merkle.fold(F.col("leaf"), F.col("proof")).alias("f"),
        ).collect()
    ]
    want = brute_manifest([(s, d, framed(d, s, t)) for s, d, t in rows], fanout)
    assert sorted(map(str, (g[:6] for g in got))) == sorted(map(str, want))
    assert all(g[6] == g[4] for g in got)


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "source string, doc_id long, leaf string")
    assert merkle.manifest(none, "source", "doc_id", "leaf").count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, 1, "ab")], none.schema), "source", "doc_id", "leaf").first()
    assert (one["subroot"], one["root"], one["proof"]) == ("ab", "ab", [])


def test_merkle_query_finds_tampering(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_merkle(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_manifest(
        [(d["source"], d["doc_id"], framed(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"])) for d in docs], 3
    )
    assert len(got) == len(docs) == len(want)
    for _, i, leaf, sub, root, proof in want:
        r = got[i]
        flat = "".join(x for run in proof for x in run if x is not None)
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (leaf, sub, root, sha(flat))
    changed = {d["doc_id"] for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and "\n" in (d["text"] or "")}
    assert changed and {i for i, r in got.items() if not r["verified"]} == changed


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_whitening(spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(rows["embedding"]).astype(np.float64) * 256).astype(np.int64)
    n, dev, w, share = brute_whitening(x)
    whole = got.pivot(index="vec_id", columns="component").loc[rows["vec_id"]]
    assert whole["deviation"][1].tolist() == dev and (got["n"] == n).all()
    assert np.allclose(np.abs(whole["whitened"].to_numpy()), np.abs(w), atol=1e-7)
    assert np.allclose(whole["explained"].to_numpy()[0], share) and (got["identity_error"] <= 1e-4).all()


def test_repeats_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r[1:]) for r in queries.op11_repeats(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert got == brute_repeats([(d["doc_id"], d["text"]) for d in docs], 100)
