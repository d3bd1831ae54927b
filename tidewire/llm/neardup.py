"""Near duplicates by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.operators.components import components
from tidewire.session import cut

# Collections of so many minhashes each; every pair of collections is one table.  There are more
# collections where it takes more to find a pair at the threshold with at least this probability.
COLLECTIONS, PER_COLLECTION = 8, 3
FOUND = 0.99
# Members of a crowded key that are compared in one task, and shingles that are looked at at once.
BLOCK = 256
COLUMNS = 8192

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer known from splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _seeds(hashes: int) -> np.ndarray:
    return mix(np.arange(1, hashes + 1, dtype=_U) * _ODD[0])[:, None]


def collections_for(percent: int) -> int:
    """The collections with which a pair that shares ``percent`` has two of them in common, mostly."""
    alike, n = max(percent / 100, 0.2) ** PER_COLLECTION, COLLECTIONS
    while (1 - alike) ** n + n * alike * (1 - alike) ** (n - 1) > 1 - FOUND:
        n += 1
    return n


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of five words of a whole text, sorted, as 64-bit hashes.

    A to Z are lower-cased; words are separated by ASCII white space.  A text of fewer words has
    its whole sequence as its one shingle, a text without words has none.
    """
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    if len(h) < 5:
        return mix((h * _ODD[: len(h)]).sum(keepdims=True, dtype=_U) + _U(len(h)))
    n = len(h) - 4
    total = h[:n] * _ODD[0]
    for k in range(1, 5):
        total = total + h[k : n + k] * _ODD[k]
    return np.unique(mix(total))


def minhashes(s: np.ndarray, hashes: int) -> np.ndarray:
    """The smallest of each of ``hashes`` permutations; ``s`` isn't empty."""
    least = np.full(hashes, np.iinfo(_U).max, _U)
    for at in range(0, len(s), 4096):
        x = (s[None, at : at + 4096] ^ _seeds(hashes)) * _ODD[1]
        least = np.minimum(least, (x ^ (x >> _U(32))).min(axis=1))
    return least


def collection_keys(least: np.ndarray) -> np.ndarray:
    """One key for each collection, out of its minhashes."""
    return mix((least.reshape(-1, PER_COLLECTION) * _ODD[:PER_COLLECTION]).sum(axis=1, dtype=_U))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _parts(batch: pa.RecordBatch, size: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def signatures(batches: Iterable[pa.RecordBatch], collections: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, cls, halves): set size, set digest, the collections' keys."""
    for whole in batches:
        for batch in _parts(whole):
            n, cls, halves = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                halves.append(_signed(collection_keys(minhashes(s, collections * PER_COLLECTION))) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(cls, pa.binary()),
                    pa.array(halves, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "cls", "halves"],
            )


def full_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _parts(whole):
            sets = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sets, pa.binary())], names=["id", "s"]
            )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share ``percent`` of their union or more."""
    one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    other = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    x, y = F.length("sa"), F.length("sb")
    both = pairs.join(one, "a").join(other, "b").where(100 * F.least(x, y) >= percent * F.greatest(x, y))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(large, small).clip(0, len(large) - 1)
                common = int((large[at] == small).sum())
                held.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of some sets share, as a matrix."""
    shingle = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number, counts = np.unique(shingle, return_inverse=True, return_counts=True)[1:]
    of_several = counts[number] > 1
    shingle, owner = np.unique(number[of_several], return_inverse=True)[1], owner[of_several]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = int(shingle.max()) + 1 if len(shingle) else 0
    for at in range(0, width, COLUMNS):
        here = (shingle >= at) & (shingle < at + COLUMNS)
        holds = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        holds[owner[here], shingle[here] - at] = 1
        out += holds @ holds.T
    return out.astype(np.int64)


def joined(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links in crowds, or between two blocks of one: (a, b), b the smallest id that a reaches in
    its crowd.  Every pair of different components is held against each other on full sets; no
    pair leaves the task."""
    rows = rows.sort_values(["key", "i", "j", "cid"])
    at = rows[["key", "i", "j"]].to_numpy()
    cid, comp, part = (rows[c].to_numpy() for c in ("cid", "component", "part"))
    sets = [np.frombuffer(s, "<u8") for s in rows["s"]]
    edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
    label = cid.copy()
    for first, last in zip([0, *edges], [*edges, len(cid)], strict=True):
        if last - first > 1:
            s = slice(first, last)
            label[s] = _reached(cid[s], comp[s], part[s] if at[first, 1] != at[first, 2] else None, sets[s], percent)
    moved = label < cid
    return pd.DataFrame({"a": cid[moved], "b": label[moved]})


def _reached(cid, comp, part, sets: list[np.ndarray], percent: int) -> np.ndarray:
    size = np.array([len(s) for s in sets])
    common = overlaps(sets)
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    near &= comp[:, None] != comp[None, :]
    if part is not None:
        near &= part[:, None] != part[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    label = cid.copy()
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            break
    return label


def duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents whose sets of shingles share ``percent`` of their union are linked; a component is
    what links reach, and its smallest doc_id is kept.  Equal sets are one class and meet once.
    Classes that share a table key are candidates: 28 keys are formed from the pairs of 8
    collections of 3 minhashes, so 24 minhashes do the work of 168.  At 0.85 a pair shares a key
    with probability 0.993, at 0.9 with 0.9995.  A lower ``percent`` has more collections, so that at
    it a pair still shares a key with 0.99 (at 0.8: 45 keys of 10 collections).  Only collections whose key another class has too
    are paired, so texts like no other take no part in the tables.

    First every class is held against the smallest of each of its keys.  Then, in the keys whose
    members are not one component by that, members of different components are held against each
    other, in blocks if the key is crowded.  Every link is confirmed on the full sets.

    Null and empty texts have no shingles and are linked with nothing.  Rows without a doc_id take
    no part: their component is null and they are kept.  Rows that share a doc_id are one document.
    """
    collections = collections_for(percent)
    rows = cut(
        df.select(C.col(doc_id).cast("long").alias("doc_id"), C.col(text).alias("text")).mapInArrow(
            lambda batches: signatures(batches, collections), "doc_id long, n long, cls binary, halves array<long>"
        ),
        "neardup-rows",
    )
    known = rows.where("doc_id is not null and n > 0")
    firsts = known.groupBy("cls").agg(F.min("doc_id").alias("cid"))
    classes = cut(
        known.join(firsts, "cls").where("doc_id = cid").dropDuplicates(["cls"]).select("cls", "cid", "halves"),
        "neardup-classes",
    )
    # Rows that share a doc_id may be of several classes; these are one document.
    of = known.join(firsts, "cls").select("doc_id", "cid").where("doc_id <> cid").distinct()
    least = known.join(firsts, "cls").groupBy("doc_id").agg(F.min("cid").alias("b"))
    same = of.join(least, "doc_id").select(F.col("cid").alias("a"), "b").where("a <> b")
    # A class of its own doc_id is tied to the others of that doc_id as well.
    own = firsts.join(least, firsts["cid"] == least["doc_id"]).select(F.col("cid").alias("a"), "b").where("a <> b")
    same = same.unionByName(own).distinct()
    members = cut(_members(classes), "neardup-members")
    heads = members.groupBy("key").agg(F.min("cid").alias("b"))
    stars = (
        members.join(heads, "key").select(F.col("cid").alias("a"), "b").where("a <> b").distinct()
    )
    wanted = cut(members.select(F.col("cid").alias("id")).distinct(), "neardup-wanted")
    texts = df.select(C.col(doc_id).cast("long").alias("id"), C.col(text).alias("text"))
    sets = cut(
        C.only(texts, wanted, "id")
        .mapInArrow(full_sets, "id long, s binary")
        .where("length(s) > 0")
        .dropDuplicates(["id"]),
        "neardup-sets",
    )
    links = cut(confirmed(stars, sets, percent).unionByName(same), "neardup-links")
    so_far = cut(components(links, "neardup-components"), "neardup-so-far")
    more = cut(_unsettled(members, so_far, sets, percent), "neardup-more")
    final = components(links.unionByName(more), "neardup-components")
    by_class = (
        classes.select("cls", "cid")
        .join(final.select(F.col("id").alias("cid"), "component"), "cid", "left")
        .select("cls", F.coalesce("component", "cid").alias("component"))
    )
    return (
        rows.select("doc_id", "n", "cls")
        .join(by_class, "cls", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _members(classes: DataFrame) -> DataFrame:
    """(key, cid): the classes of every table key that two classes or more have."""
    halves = classes.select("cid", F.posexplode("halves").alias("k", "half"))
    shared = halves.groupBy("k", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = (
        halves.join(shared, ["k", "half"])
        .groupBy("cid")
        .agg(F.array_sort(F.collect_list(F.struct("k", "half"))).alias("h"))
        .where("size(h) > 1")
    )
    pairs = """flatten(transform(h, x -> transform(
        filter(h, y -> y.k > x.k), y -> xxhash64(x.k, y.k, x.half, y.half))))"""
    keyed = cut(held.select("cid", F.explode(F.expr(pairs)).alias("key")), "neardup-keyed")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(met, "key")


def _unsettled(members: DataFrame, so_far: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes that share a key and are of different components so far."""
    placed = members.join(so_far.select(F.col("id").alias("cid"), "component"), "cid", "left").select(
        "key", "cid", F.coalesce("component", "cid").alias("component")
    )
    mixed = cut(
        placed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x < y and n > 2")
        .select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")),
        "neardup-mixed",
    )
    # Small crowds are handed over many at a time, a large one block pair by block pair.
    small = max(1, -(-(mixed.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    alone = F.lit(small) + F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 << 40))
    bundle = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(small))).otherwise(alone)
    dealt = (
        placed.join(mixed, "key")
        .withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .withColumn("bundle", bundle)
        .drop("other", "parts", "n")
        .join(sets.withColumnRenamed("id", "cid"), "cid")
    )
    found = dealt.groupBy("bundle").applyInPandas(lambda rows: joined(rows, percent), "a long, b long")
    return found.distinct()


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df`` whose document is kept; rows without a doc_id stay."""
    gone = duplicates(df, doc_id, text, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    named = df.select(C.packed(df), C.col(doc_id).cast("long").alias("id"))
    kept = C.only(named, cut(gone, "neardup-gone"), "id", "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
