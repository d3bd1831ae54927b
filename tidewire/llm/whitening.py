"""Whitening of vectors by a covariance that is recovered from sums of squares alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.session import cut

SCALE = 256
COMPONENTS = 4
# Rows that are squared at once, and the bits of the numbers whose squares then add up in 62.
ROWS = 4096
BITS = 24
# Exact sums of any size travel as numbers of so many bits each.
LIMB = 30
# Components below this share of the largest eigenvalue have no variance but rounding.
RANK = 1e-12


def steps(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) as whole numbers; null where the vector can't be used."""
    entries = F.transform(vec, lambda c: c.cast("double"))
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * scale)))


def matrix(x: pa.Array, dims: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x minus the sums, exactly; as Python's whole numbers where 62 bits can't hold twice that."""
    largest = max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if n * largest + max(map(abs, sums), default=0) >= 1 << 60:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * np.int64(n) - np.array(sums, dtype=np.int64)


def square_sums(s: np.ndarray) -> list[int]:
    """The exact sum of the squares of each column."""
    if s.dtype == object:
        return [int(x) for x in (s * s).sum(axis=0)] if len(s) else [0] * s.shape[1]
    out = [0] * s.shape[1]
    for at in range(0, len(s), ROWS):
        u = np.abs(s[at : at + ROWS])
        parts, top = [], int(u.max(initial=0)).bit_length()
        for low in range(0, max(top, 1), BITS):
            parts.append((u >> low) & ((1 << BITS) - 1))
        for i, p in enumerate(parts):
            for j in range(i, len(parts)):
                got = (p * parts[j]).sum(axis=0)
                shift = BITS * (i + j) + (i != j)
                out = [o + (int(g) << shift) for o, g in zip(out, got, strict=True)]
    return out


def limbs(at: int, value: int) -> Iterator[tuple[int, int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield at, k, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        k += 1


def added(totals: Iterable[Iterable[int]]) -> Iterator[pa.RecordBatch]:
    """Sums of a task as (at, limb, value)."""
    rows = [row for at, v in enumerate(totals) for row in limbs(at, v)]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = [pa.int32(), pa.int32(), pa.int64()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays(arrays, names=["at", "limb", "value"])


def gathered(partial: DataFrame, size: int) -> list[int]:
    """The exact totals of all tasks: one row per sum and limb reaches the driver."""
    out = [0] * size
    for at, limb, value in partial.groupBy("at", "limb").agg(F.sum("value")).collect():
        out[at] += value << (LIMB * limb)
    return out


def column_sums(fit: DataFrame, dims: int) -> list[int]:
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * dims
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            safe = not x.size or max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 1 << 62
            got = (x if safe else x.astype(object)).sum(axis=0)
            totals = [t + int(g) for t, g in zip(totals, got, strict=True)]
        yield from added(totals)

    return gathered(fit.select("x").mapInArrow(partial, "at int, limb int, value long"), dims)


def pairs(dims: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dims) for j in range(i, dims)]


def polarised(fit: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """The covariances, times n to the third, as exact whole numbers.

    With d = n * x - sums, the squares of d are summed for every dimension, and of the sum of two
    for every pair of them; half of what the latter has more than its dimensions is the covariance.
    """
    dims = len(sums)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dims * (dims + 1) // 2)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            for at in range(0, len(x), ROWS):
                d, got = centred(x[at : at + ROWS], n, sums), []
                for i in range(dims):
                    both = d[:, i:] + d[:, i : i + 1]
                    both[:, 0] = d[:, i]
                    got += square_sums(both)
                totals = [t + g for t, g in zip(totals, got, strict=True)]
        yield from added(totals)

    found = gathered(fit.select("x").mapInArrow(partial, "at int, limb int, value long"), dims * (dims + 1) // 2)
    squares = dict(zip(pairs(dims), found, strict=True))
    out = [[0] * dims for _ in range(dims)]
    for (i, j), q in squares.items():
        out[i][j] = out[j][i] = q if i == j else (q - squares[i, i] - squares[j, j]) // 2
    return out


def components(cov: list[list[int]], n: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive;
    and the trace."""
    v = np.array([[c / n**3 for c in row] for row in cov])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs, sum(cov[i][i] for i in range(len(cov))) / n**3


def whiten(df: DataFrame, vec: str, count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Every usable row of ``df`` as ``row``, once for each of the first ``count`` components of the
    vectors' covariance, with ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``.

    Entries become floor(scale * entry).  The covariance is that of the distinct vectors.  Sums and
    squares are whole numbers of any size, added up in each task, so nothing is rounded before the
    eigenvectors; the driver gets one number per pair of dimensions.  Copies are collapsed in each
    task before vectors are shuffled.

    Rows whose vector is null or has null, infinite or undefined entries give no rows, nor do rows of
    another length than most have (the longer one if two are as common), and vectors without
    entries.  Repeated rows are rows of their own with equal results.  A component without variance
    has a null ``whitened`` and takes no part in ``identity_error``, which is null if there is none
    with variance; without any variance ``explained`` is 0.  ``deviation`` is null beyond 38 digits;
    entries beyond 64 bits count as the largest number.  No rows give no rows.  Any column names are fine.
    """
    usable = df.select(C.packed(df), steps(C.col(vec), scale).alias("x")).where("x is not null")
    lengths = usable.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    shape = usable.where(F.size("x") == dims)
    fit = cut(shape.select("x").distinct(), "whitening-fit")
    n = fit.count()
    if n == 0 or dims == 0:
        return _results(shape.where("false").withColumn("deviation", F.lit(None)), 0, F.lit(None), [], None)
    sums = column_sums(fit, dims)
    values, vectors, trace = components(polarised(fit, n, sums), n, count)
    varied = values > RANK * max(float(values[0]), 0.0)
    scaled = vectors / np.sqrt(np.where(varied, values, 1.0))
    shares = [float(v) / trace if trace > 0 else 0.0 for v in values]

    @F.arrow_udf("array<double>")
    def projected(x: pa.Array) -> pa.Array:
        w = (centred(matrix(x, dims), n, sums) / n).astype(np.float64) @ scaled
        whole = pa.array(w.ravel(), mask=np.tile(~varied, len(x)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(varied), pa.int32()), whole)

    @F.arrow_udf("decimal(38,0)")
    def deviation(x: pa.Array) -> pa.Array:
        totals = square_sums(centred(matrix(x, dims), n, sums).T)
        return pa.array([Decimal(t) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))

    good = [i for i in range(len(varied)) if varied[i]]
    w = fit.select(projected("x").alias("w"))
    checks = [
        F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - (1.0 if i == j else 0.0)) for i in good for j in good if i <= j
    ]
    error = w.agg(F.array_max(F.array(*checks))).first()[0] if checks else None
    return _results(shape.withColumn("deviation", deviation("x")), n, projected("x"), shares, error)


def _results(rows: DataFrame, n: int, whitened: Column, shares: list[float], error: float | None) -> DataFrame:
    each = rows.select("row", "deviation", F.posexplode(whitened.cast("array<double>")).alias("i", "whitened"))
    return each.select(
        "row",
        (F.col("i") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        F.get(F.lit(shares).cast("array<double>") if shares else F.expr("cast(array() as array<double>)"), F.col("i")).alias(
            "explained"
        ),
        F.lit(error).cast("double").alias("identity_error"),
    )
