"""Near duplicates of embeddings by hashing to points of the E8 lattice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.llm.neardup import mix
from tidewire.operators.components import components
from tidewire.session import cut

# Tables, and lattice points that make up a cell of a table.
TABLES, LATTICES = 20, 3
# The lattice's scale, in standard deviations of a projected random unit vector.
SCALE = 2.0
# Vectors of a cell that are compared at once, and rows of small cells that one call is given.
BLOCK = 1024
BUNDLE = 4096
# The 240 shortest vectors of the lattice: steps to the neighbours of a point.
STEPS = np.array(
    [
        [p if k == i else q if k == j else 0.0 for k in range(8)]
        for i, j in combinations(range(8), 2)
        for p, q in product((1.0, -1.0), repeat=2)
    ]
    + [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points of whole coordinates with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: the better of the even points and those moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


_ODD = mix(np.arange(1, 8 * LATTICES + 1, dtype=np.uint64)) | np.uint64(1)


def cells(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors of one dimension each table's home cell and the neighbouring cell to probe.

    A table projects at random to 24 dimensions and decodes each third to a lattice point.  The
    neighbour is reached by the one step that comes nearest to the projected vector.
    """
    n, d = x.shape
    rng = np.random.default_rng([seed, d])
    homes, probes = np.empty((n, TABLES), np.uint64), np.empty((n, TABLES), np.uint64)
    rows = np.arange(n)
    for t in range(TABLES):
        turn = rng.normal(size=(d, 8 * LATTICES))
        if d >= 8 * LATTICES:
            turn = np.linalg.qr(turn)[0]
        y = x @ turn * (np.sqrt(d) / SCALE)
        points, gains, moves = [], [], []
        for k in range(LATTICES):
            part = y[:, 8 * k : 8 * k + 8]
            point = nearest(part)
            gain = (part - point) @ STEPS.T
            best = gain.argmax(axis=1)
            points.append(point)
            gains.append(gain[rows, best])
            moves.append(STEPS[best])
        which = np.argmax(gains, axis=0)
        moved = [p + m * (which == k)[:, None] for k, (p, m) in enumerate(zip(points, moves, strict=True))]
        salt = mix(np.array([t * 1_000_003 + d], np.uint64))[0]
        for out, found in ((homes, points), (probes, moved)):
            whole = np.rint(2 * np.hstack(found)).astype(np.int64).view(np.uint64)
            out[:, t] = mix((whole * _ODD).sum(axis=1, dtype=np.uint64) ^ salt)
    return homes, probes


def unit_rows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x, x / np.linalg.norm(x / np.abs(x).max(axis=1)[:, None], axis=1)[:, None] / np.abs(x).max(axis=1)[:, None]


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) to (vec_id, raw, cls): the vector's bytes and their digest, null if it can't link."""
    for batch in batches:
        raw, cls = [], []
        for v in batch.column("v").to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    x = None
            raw.append(None if x is None else x.tobytes())
            cls.append(None if x is None else xxhash.xxh3_128_digest(raw[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(cls, pa.binary())],
            names=["vec_id", "raw", "cls"],
        )


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("raw").to_pylist()
        homes, probes = [None] * len(raw), [None] * len(raw)
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for part in np.array_split(at, -(-len(at) // 2000)):
                h, p = cells(unit_rows([raw[i] for i in part])[1])
                for i, a, b in zip(part, h, p, strict=True):
                    homes[i], probes[i] = a.tobytes(), b.tobytes()
        cell = [np.frombuffer(h + p, np.int64) for h, p in zip(homes, probes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("cid", "mult", "raw")),
                pa.array(homes, pa.binary()),
                pa.array(probes, pa.binary()),
                pa.array(cell, pa.list_(pa.int64())),
            ],
            names=["cid", "mult", "raw", "homes", "probes", "cells"],
        )


def _linked(cid, mult, x, homes, probes, part, home, t: int, apart: bool, least: float):
    """Links and labels of one cell, or of two blocks of one; the arrays are in order of cid."""
    near = x @ x.T >= least
    near &= home[:, None] | home[None, :]
    if apart:
        near &= part[:, None] != part[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    label = cid.copy()
    if not len(a):
        return np.zeros(len(cid), np.int64), label
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            break
    count = np.zeros(len(a), bool)
    for at in range(0, len(a), 200_000):
        p, q = a[at : at + 200_000], b[at : at + 200_000]
        met = (homes[p] == homes[q]) | (homes[p] == probes[q]) | (probes[p] == homes[q])
        first = met.argmax(axis=1) == t
        # If each probes the other's home, only the home of the smaller cid (p's) counts.
        both = (probes[p, t] == homes[q, t]) & (probes[q, t] == homes[p, t])
        count[at : at + 200_000] = first & ~(both & ~home[p])
    a, b = a[count], b[count]
    links = np.bincount(a, mult[b], len(cid)) + np.bincount(b, mult[a], len(cid))
    return links.astype(np.int64), label


def compare(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links within cells, or between two blocks of one: (cid, links, label).

    A pair is counted in the first table in which it meets, and there in one cell; ``label`` is
    the smallest cid that links reach inside its cell.  No pair leaves the task.
    """
    rows = rows.sort_values(["t", "cell", "i", "j", "cid"])
    at = rows[["t", "cell", "i", "j"]].to_numpy()
    cid, mult, part = (rows[c].to_numpy() for c in ("cid", "mult", "part"))
    home, raw = rows["home"].to_numpy(bool), rows["raw"].to_numpy()
    homes = np.frombuffer(b"".join(rows["homes"]), np.int64).reshape(-1, TABLES)
    probes = np.frombuffer(b"".join(rows["probes"]), np.int64).reshape(-1, TABLES)
    edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
    links, label = np.zeros(len(cid), np.int64), cid.copy()
    for a, b in zip([0, *edges], [*edges, len(cid)], strict=True):
        if b - a > 1 and home[a:b].any():
            s = slice(a, b)
            x = unit_rows(raw[s].tolist())[1]
            links[s], label[s] = _linked(
                cid[s], mult[s], x, homes[s], probes[s], part[s], home[s], int(at[a, 0]), at[a, 2] != at[a, 3], least
            )
    kept = (links > 0) | (label < cid)
    return pd.DataFrame({"cid": cid[kept], "links": links[kept], "label": label[kept]})


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of ``df``: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors that share a cell, or one's cell and the cell that the other probes, in any of 20
    tables are compared by cosine in double precision; those at ``least`` or more are linked.
    Equal vectors are one class that is compared once and counted as often as it occurs.  A cell of
    any size is compared block by block, and only counts and labels leave a task.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different dimensions.  Rows without a vec_id take no part: their component is
    null, they have no links and are kept.  Rows that share a vec_id are vectors of their own.
    """
    rows = cut(
        df.select(C.col(vec_id).cast("long").alias("vec_id"), C.col(vector).cast("array<double>").alias("v")).mapInArrow(
            _read, "vec_id long, raw binary, cls binary"
        ),
        "lattice-rows",
    )
    classes = cut(
        rows.where("vec_id is not null and cls is not null")
        .groupBy("cls")
        .agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first_id"), F.min("raw").alias("raw"))
        .select("*", F.monotonically_increasing_id().alias("cid")),
        "lattice-classes",
    )
    hashed = cut(
        classes.select("cid", "mult", "raw").mapInArrow(
            _hashed, "cid long, mult long, raw binary, homes binary, probes binary, cells array<long>"
        ),
        "lattice-hashed",
    )
    spots = hashed.select("cid", F.posexplode("cells").alias("k", "cell")).select(
        "cid", "cell", (F.col("k") % TABLES).alias("t"), (F.col("k") < TABLES).alias("home")
    )
    shared = (
        spots.groupBy("t", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("held"))
        .where("n > 1 and held")
        .select("t", "cell", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    )
    shared = cut(shared, "lattice-shared")
    size = shared.agg(F.sum("n")).first()[0] or 0
    # Small cells are handed over many at a time, a large one block pair by block pair.
    small = max(1, -(-size // BUNDLE))
    alone = F.lit(small) + F.pmod(F.xxhash64("t", "cell", "i", "j"), F.lit(1 << 40))
    bundle = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("t", "cell"), F.lit(small))).otherwise(alone)
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    members = (
        spots.join(shared, ["t", "cell"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .withColumn("bundle", bundle)
        .drop("other", "parts", "n")
        .join(hashed.drop("cells"), "cid")
    )
    met = cut(
        members.groupBy("bundle").applyInPandas(
            lambda rows: compare(rows, least), "cid long, links long, label long"
        ),
        "lattice-met",
    )
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(met.select(F.col("cid").alias("a"), F.col("label").alias("b")), "lattice-components")
    placed = (
        classes.select("cls", "cid", "mult", "first_id")
        .join(links, "cid", "left")
        .join(reached.withColumnRenamed("id", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least_id = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = placed.join(least_id, "component").select(
        "cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")
    )
    linked = F.col("vec_id").isNotNull()
    return (
        rows.select("vec_id", "cls")
        .join(by_class, "cls", "left")
        .select(
            "vec_id",
            F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(linked, F.coalesce("component_id", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
