"""Removal of repeated byte strings by suffix sorts that compare prefix hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.session import cut, scratch_path

# Strings of so many bytes are looked for, by way of anchors of so many.
LENGTH, GRAM = 100, 40
# Bytes that are hashed at once, and bytes of texts whose contexts are held against each other at once.
SLICE, CHUNK = 1_000_000, 8_000_000
# Contexts that are handed to one task, sorted at once, and that may share one key.
BUNDLE, SORTED, CROWD = 1 << 14, 1 << 12, 1 << 14

KINDS = "a long, t long, pos int, left int, size int, key long, ctx binary"
CONTEXTS = pa.schema(
    [("a", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("size", pa.int32())]
    + [("key", pa.int64()), ("ctx", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())]
)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer known from splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every byte; powers of the base, and of its inverse, modulo 2 to the 64th."""
    letters = _mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    out = [letters]
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size + 1, base, _U)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=_U))
    return tuple(out)


class Prefixes:
    """Prefix polynomial hashes of some bytes: the hash of any part of them takes two look-ups."""

    def __init__(self, flat: np.ndarray):
        size = 1 << max(16, (len(flat) - 1).bit_length())
        letters, powers, self.inverse = _tables(size)
        self.flat = flat
        self.upto = np.zeros(len(flat) + 1, _U)
        np.cumsum(letters[flat] * powers[: len(flat)], dtype=_U, out=self.upto[1:])

    def of(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return (self.upto[start + size] - self.upto[start]) * self.inverse[start]

    def extension(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """How many bytes from ``x`` and from ``y`` on are equal, up to ``most``, by binary search."""
        hx, hy, ix, iy = self.upto[x], self.upto[y], self.inverse[x], self.inverse[y]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), most)
        for _ in range(int(most).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.upto[x + mid] - hx) * ix == (self.upto[y + mid] - hy) * iy
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray, most: int, ties: np.ndarray) -> np.ndarray:
        """Whether the bytes from ``x`` on sort before those from ``y`` on; ``ties`` if they are equal."""
        common = self.extension(x, y, most)
        equal = common == most
        last = np.minimum(common, most - 1)
        return np.where(equal, ties, self.flat[x + last] < self.flat[y + last])


def _runs(changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs, given where a new one begins (but for the first)."""
    starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
    return starts, np.diff(np.append(starts, len(changes) + 1))


def suffix_sort(h: Prefixes, at: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``at`` by group and their first ``most`` bytes, and how many bytes each has
    in common with the one before it (-1 for the first of a group).

    A mergesort from the bottom up, of all groups at once: every suffix looks up its place in the
    run beside its own by binary search.  Hashes may collide, so every two neighbours are compared by
    their bytes in the end; if their order isn't proven so, the bytes themselves are sorted.
    """
    order = np.argsort(group, kind="stable")
    starts, sizes = _runs(np.diff(group[order]) != 0)
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    place = np.arange(len(order)) - first
    width, largest = 1, int(sizes.max(initial=0))
    while width < largest:
        run = place // width
        right = run % 2 == 1
        low = np.minimum((run ^ 1) * width, size)
        high = np.minimum(low + width, size)
        base, own = low.copy(), at[order]
        for _ in range(int(width).bit_length()):
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) >> 1
            other = at[order[first[open_] + mid]]
            less = h.before(other, own[open_], most, right[open_])
            low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
        moved = first + (run & ~1) * width + (place - run * width) + (low - base)
        merged = np.empty_like(order)
        merged[moved] = order
        order = merged
        width *= 2
    common = proven(h, at[order], group[order], most)
    if common is None:
        raw = h.flat.tobytes()
        keys = [(g, raw[p : p + most]) for g, p in zip(group.tolist(), at.tolist(), strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        common = proven(h, at[order], group[order], most)
    return order, common


def proven(h: Prefixes, at: np.ndarray, group: np.ndarray, most: int, rows: int = 1 << 15) -> np.ndarray | None:
    """How many bytes each suffix has in common with the one before, by the bytes themselves; None if
    one sorts before its predecessor."""
    common = np.full(len(at), -1)
    same = np.flatnonzero(group[1:] == group[:-1])
    for part in range(0, len(same), rows):
        i = same[part : part + rows]
        x = h.flat[at[i][:, None] + np.arange(most)]
        y = h.flat[at[i + 1][:, None] + np.arange(most)]
        unlike = x != y
        where = unlike.argmax(axis=1)
        alike = ~unlike.any(axis=1)
        k = np.arange(len(i))
        if not (alike | (x[k, where] < y[k, where])).all():
            return None
        common[i + 1] = np.where(alike, most, where)
    return common


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over all windows of ``width``."""
    span = 1
    while span * 2 <= width:
        x, span = pick(x[:-span], x[span:]), span * 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(flat: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents that lie side by side (``ends``: from 0 on).

    Of the strings of ``gram`` bytes in each window of ``length`` bytes those of the least hash are
    anchors.  So equal windows have equal anchors at equal places, wherever they are.
    """
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    width = length - gram + 1
    for low in range(0, len(flat) - length + 1, SLICE):
        part = flat[low : low + SLICE + length - 1]
        h = Prefixes(part)
        windows = len(part) - length + 1
        here = slice(max(0, np.searchsorted(ends, low, side="right") - 1), np.searchsorted(ends, low + windows) + 1)
        mine = ends[here] - low
        opens, shuts = np.clip(mine[:-1], 0, windows), np.clip(mine[1:] - length + 1, 0, windows)
        whole = shuts > opens
        inside = np.zeros(windows + 1, np.int32)
        np.add.at(inside, opens[whole], 1)
        np.add.at(inside, shuts[whole], -1)
        g = _mix(h.of(np.arange(len(part) - gram + 1), gram)) | _U(1)
        least = _slide(g, width, np.minimum)
        least[np.cumsum(inside[:-1]) == 0] = 0
        rim = np.zeros(width - 1, _U)
        chosen = np.flatnonzero(_slide(np.concatenate([rim, least, rim]), width, np.maximum) == g)
        places.append(chosen + low)
        hashes.append(g[chosen])
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column side by side, and where they end; a null has none."""
    column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def marked(batches: Iterable[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(a, t, text) to (a, t, pos, gram, again, first): the anchors, whether the batch has another one of
    that gram, and whether it is the batch's first."""
    for batch in batches:
        flat, ends = _bytes(batch.column("text"))
        at, hashes = anchors(flat, ends, length, gram)
        doc = np.searchsorted(ends, at, side="right") - 1
        _, one, of, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        first = np.zeros(len(at), bool)
        first[one] = True
        mine = pa.array(doc)
        arrays = [
            batch.column("a").take(mine),
            batch.column("t").take(mine),
            pa.array((at - ends[doc]).astype(np.int32)),
            pa.array(_signed(hashes)),
            pa.array(count[of] > 1),
            pa.array(first),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "t", "pos", "gram", "again", "first"])


def contexts(batches: Iterable[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(a, t, text, at) to the surroundings of the places ``at``: (a, t, pos, left, size, key, ctx).

    A context is all that windows around an anchor can hold, ``left`` bytes of it before the anchor.
    Of equal ones that are near each other the earliest is returned; the others stand in rows
    without ``ctx``, joined to stretches of ``size`` bytes from ``pos`` on.
    """
    side = length - gram
    for whole in batches:
        sizes = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False))
        low = 0
        while low < whole.num_rows:
            base = sizes[low - 1] if low else 0
            batch = whole.slice(low, max(1, int(np.searchsorted(sizes, base + CHUNK)) - low))
            low += batch.num_rows
            flat, ends = _bytes(batch.column("text"))
            counts = pc.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            pos = batch.column("at").flatten().to_numpy().astype(np.int64)
            a, t = batch.column("a").to_numpy()[doc], batch.column("t").to_numpy()[doc]
            order = np.lexsort((pos, t, a))
            doc, pos, a, t = doc[order], pos[order], a[order], t[order]
            start = np.maximum(pos - side, 0)
            size = np.minimum(pos + length, (ends[1:] - ends[:-1])[doc]) - start
            raw = flat.tobytes()
            places = zip((ends[doc] + start).tolist(), size.tolist(), (pos - start).tolist(), strict=True)
            seen: dict[tuple, int] = {}
            ctx, leader = [], np.zeros(len(pos), np.int64)
            for i, (p, n, left) in enumerate(places):
                own = raw[p : p + n]
                ctx.append(own)
                leader[i] = seen.setdefault((left, own), i)
            lead = leader == np.arange(len(pos))
            # Repeated rows are one document, whose places are no repeats of themselves.
            same = (a == a[leader]) & (t == t[leader]) & (pos == pos[leader])
            mine = np.flatnonzero(lead)
            left = pos - start
            firsts = [ctx[i] for i in mine]
            grams = [xxhash.xxh3_64_intdigest(c[x : x + gram]) for c, x in zip(firsts, left[mine].tolist(), strict=True)]
            yield _context_rows(a[mine], t[mine], pos[mine], left[mine], size[mine], np.array(grams, _U), firsts)
            rest = np.flatnonzero(~same)
            if len(rest):
                a, t, start, size = stretches(a[rest], t[rest], start[rest], size[rest])
                none = np.zeros(len(a), _U)
                yield _context_rows(a, t, start, none, size, none, [None] * len(a))


def _context_rows(a, t, pos, left, size, key, ctx) -> pa.RecordBatch:
    narrow = [pa.array(np.asarray(x, np.int32)) for x in (pos, left, size)]
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(t), *narrow, pa.array(_signed(key)), pa.array(ctx, pa.binary())],
        names=["a", "t", "pos", "left", "size", "key", "ctx"],
    )


def stretches(a, t, start, size) -> tuple[np.ndarray, ...]:
    """Intervals that touch, joined; those of a document stand together, by their start."""
    change = (np.diff(a) != 0) | (np.diff(t) != 0)
    doc = np.concatenate([[0], np.cumsum(change)])
    top = int((start + size).max(initial=0)) + 1
    reach = np.maximum.accumulate(doc * top + start + size)
    opens = np.concatenate([[True], doc[1:] * top + start[1:] > reach[:-1]])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(a)) - 1
    return a[first], t[first], start[first], (reach - doc * top)[last] - start[first]


def spread_out(ctx: list[bytes], left: np.ndarray, before: int, behind: int) -> np.ndarray:
    """Contexts as rows of a matrix, their anchors in one column.  The rest holds a byte that UTF-8 has not."""
    size = np.array([len(c) for c in ctx], np.int64)
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size + left - before, size)
    out = np.full((len(ctx), before + behind), 0xFF, np.uint8)
    out[np.repeat(np.arange(len(ctx)), size), column] = flat
    return out


def shared_windows(grid: np.ndarray, before: int, group: np.ndarray, least: np.ndarray, most: np.ndarray, length: int):
    """(row, away): the windows, beginning ``away`` bytes before the anchor, that an earlier row of the
    group has too.  A row's windows begin from ``least`` to ``most`` bytes before its anchor.

    Rows are sorted by what follows the anchor and by what precedes it, read backwards.  Two windows
    are equal if so much is common on both sides, so the classes that common extensions of neighbours
    leave, on either side, tell which.
    """
    rows, behind = len(grid), grid.shape[1] - before
    sides = []
    for part, size in ((grid[:, before:], behind), (grid[:, :before][:, ::-1], before)):
        flat = np.ascontiguousarray(part).ravel()
        order, common = suffix_sort(Prefixes(flat), np.arange(rows) * size, group, size)
        rank = np.empty(rows, np.int64)
        rank[order] = np.arange(rows)
        widest = np.maximum(common, np.append(common[1:], -1))
        sides.append((common, rank, widest[rank]))
    (right, at_right, most_right), (left, at_left, most_left) = sides
    least, most = np.maximum(least, length - most_right), np.minimum(most, most_left)
    out_row, out_away = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for away in range(int(least.min(initial=length)), int(most.max(initial=-1)) + 1):
        here = np.flatnonzero((least <= away) & (away <= most))
        if not len(here):
            continue
        after = np.cumsum(right < length - away)[at_right[here]]
        ahead = np.cumsum(left < away)[at_left[here]]
        _, first, of = np.unique(after * (rows + 1) + ahead, return_index=True, return_inverse=True)
        again = here[here != here[first][of]]
        out_row.append(again)
        out_away.append(np.full(len(again), away))
    return np.concatenate(out_row), np.concatenate(out_away)


def repeated(table: pa.Table, length: int) -> pa.Table:
    """Contexts of some keys to (a, t, pos, size): what windows around an anchor repeat of earlier ones."""
    a, t, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "t", "pos"))
    # In the order of documents and places; repeated rows share a turn.
    order = np.lexsort((pos, t, a))
    table = table.take(pa.array(order))
    a, t, pos, left, lo, hi, key = (
        table.column(c).to_numpy().astype(np.int64) for c in ("a", "t", "pos", "left", "lo", "hi", "key")
    )
    ctx = table.column("ctx").to_pylist()
    size = np.array([len(c) for c in ctx], np.int64)
    least, most = np.maximum(lo, length - (size - left)), np.minimum(hi, left)
    turn = np.cumsum(np.append(0, (np.diff(a) != 0) | (np.diff(t) != 0) | (np.diff(pos) != 0)))[: len(a)]
    nearest, farthest = np.full(len(a), length), np.full(len(a), -1)
    # Equal contexts: the earliest stands for all, the others repeat it whole.
    leader: dict[tuple, int] = {}
    names = zip(key.tolist(), lo.tolist(), left.tolist(), ctx, strict=True)
    lead = np.fromiter((leader.setdefault(name, i) for i, name in enumerate(names)), np.int64, len(a))
    later = turn != turn[lead]
    nearest[later], farthest[later] = least[later], most[later]
    mine = np.flatnonzero(lead == np.arange(len(a)))
    mine = mine[np.argsort(key[mine], kind="stable")]
    starts, sizes = _runs(np.diff(key[mine]) != 0) if len(mine) else (np.zeros(0, int), np.zeros(0, int))
    several = np.repeat(sizes > 1, sizes)
    mine, of = mine[several], np.repeat(np.arange(len(sizes)), sizes)[several]
    before = int(hi.max(initial=0))
    begin = 0
    while begin < len(mine):
        end = np.searchsorted(of, of[min(begin + SORTED, len(mine)) - 1], side="right")
        rows, group, begin = mine[begin:end], of[begin:end], end
        grid = spread_out([ctx[i] for i in rows], left[rows], max(before, int(left[rows].max()), 1), length)
        row, away = shared_windows(grid, grid.shape[1] - length, group, least[rows], most[rows], length)
        np.minimum.at(nearest, rows[row], away)
        np.maximum.at(farthest, rows[row], away)
    hit = farthest >= nearest
    begin = (pos - farthest)[hit]
    return pa.table(
        {"a": a[hit], "t": t[hit], "pos": begin.astype(np.int32), "size": (length + farthest - nearest)[hit].astype(np.int32)}
    )


def halved(table: pa.Table, length: int) -> pa.Table:
    """Contexts of one crowded key under two longer keys each, one for either half of their windows.

    What the windows of a half don't reach is cut off; of contexts that are equal then the earliest
    goes on, the others repeat it whole (rows without ``ctx``).
    """
    a, t, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "t", "pos"))
    table = table.take(pa.array(np.lexsort((pos, t, a))))
    columns = (table.column(c).to_pylist() for c in ("a", "t", "pos", "left", "lo", "hi", "ctx"))
    seen: dict[tuple, tuple] = {}
    out = []
    for a, t, pos, left, lo, hi, ctx in zip(*columns, strict=True):
        middle = (lo + hi) // 2
        for x, y in ((lo, middle), (middle + 1, hi)):
            low, high = max(x, length - (len(ctx) - left)), min(y, left)
            if low > high:
                continue
            span = ctx[left - high : left - low + length]
            first = seen.setdefault((x, high, span), (a, t, pos))
            if first != (a, t, pos):
                out.append((a, t, pos - high, 0, len(span), 0, None, x, y))
            else:
                shared = ctx[left - x : left - y + length]
                key = xxhash.xxh3_64_intdigest(shared, seed=x << 8 | y)
                out.append((a, t, pos, high, len(span), key - (key >> 63 << 64), span, x, y))
    columns = zip(*out, strict=True) if out else [()] * len(CONTEXTS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, CONTEXTS, strict=True)], schema=CONTEXTS)


def _repeats(found: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """(a, t, pos, size): all stretches of contexts that repeat earlier ones."""
    out = []
    todo = found.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - gram))
    while True:
        out.append(todo.where("ctx is null").select("a", "t", "pos", "size"))
        todo = todo.where("ctx is not null")
        counts = cut(todo.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "repeats-counts")
        total, many = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > crowd)).first()
        crowded = counts.where(F.col("n") > crowd)
        calm = C.only(todo, crowded.select("key"), "key", "left_anti") if many else todo
        bundle = F.pmod(F.xxhash64("key"), F.lit(total // BUNDLE + 1))
        sorted_ = calm.groupBy(bundle.alias("bundle")).applyInArrow(
            lambda table: repeated(table, length), "a long, t long, pos int, size int"
        )
        out.append(cut(sorted_, "repeats-sorted"))
        if not many:
            return reduce(DataFrame.unionByName, out)
        # A crowded key is dealt to parts; what each of them collapses is counted anew.
        parts = F.ceil(F.col("n") / BUNDLE).cast("long").alias("parts")
        keys = crowded.select("key", parts)
        wide = todo.join(F.broadcast(keys) if many <= C.LOOKUP_ROWS else keys, "key")
        part = F.pmod(F.xxhash64("a", "t", "pos"), F.col("parts"))
        halves = wide.groupBy("key", part.alias("part")).applyInArrow(
            lambda table: halved(table, length), KINDS + ", lo int, hi int"
        )
        todo = _cut_small(halves, "repeats-halves")


def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, cuts) to (row, n_bytes, spans, kept)."""
    for batch in batches:
        n, spans, left = [], [], []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            text, merged = text or b"", []
            for c in sorted((c["pos"], c["pos"] + c["size"]) for c in cuts or ()):
                if merged and c[0] <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], c[1]))
                else:
                    merged.append(c)
            edges = [0, *(x for s in merged for x in s), len(text)]
            n.append(len(text))
            spans.append([{"start": x, "end": y} for x, y in merged])
            left.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())],
            names=["row", "n_bytes", "spans", "kept"],
        )


def _cut_small(df: DataFrame, name: str) -> DataFrame:
    """``cut`` for large tables that are read few times: smaller, and a little slower."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ordered(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, a, t, text): documents in the order of (a, t), the id and, where several rows share it, a hash of
    the text."""
    docs = df.select(
        F.struct(*[C.col(c) for c in df.columns if c != text]).alias("row"),
        F.coalesce(C.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("a"),
        C.col(text).cast("binary").alias("text"),
    )
    twice = cut(docs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats-ids")
    if twice.isEmpty():
        return docs.withColumn("t", F.lit(0).cast("long"))
    tie = F.when(F.col("n").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return C.attach(docs, twice, "a", "n", docs.count()).withColumn("t", tie).drop("n")


def remove_repeats(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    crowd: int = CROWD,
) -> DataFrame:
    """Every row of ``df`` without its text as ``row``, with ``n_bytes``, ``spans`` and ``kept``.

    Every byte covered by a string of ``length`` bytes that also starts earlier, in a document of a
    smaller ``doc_id`` or further ahead in the same one, is removed: ``spans`` are the removed runs,
    by bytes, ``kept`` the remaining bytes, which may end inside a character.

    Every window of ``length`` bytes is met at its anchors, so only anchors are counted and only
    those that occur twice bring their surroundings along.  These are sorted as suffixes, on both
    sides of the anchor, and what neighbours have in common tells the windows that are equal.  Equal grams and
    contexts are collapsed in each task before they are shuffled.  A key of more than ``crowd``
    contexts is replaced by two longer ones, each for half of the windows and with shorter contexts, of
    which equal ones collapse; keys of whole windows have equal contexts only.

    Null texts are empty ones; texts shorter than ``length`` lose nothing.  Documents without an id come
    after all others.  Equal ids with different texts stand in the order of a hash of the text; rows
    equal in id and text are one document and have equal results.  No rows give no rows.  Any other
    column names are fine.
    """
    docs = _ordered(df, doc_id, text)
    texts = docs.select("a", "t", "text").where(F.length("text") >= length)
    kinds = "a long, t long, pos int, gram long, again boolean, first boolean"
    marks = _cut_small(texts.mapInArrow(lambda b: marked(b, length, gram), kinds), "repeats-marks")
    met = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    elsewhere = marks.where("first").withColumn("n", met).where("n > 1 and not again")
    shared = marks.where("again").select("a", "t", "pos").unionByName(elsewhere.select("a", "t", "pos"))
    places = shared.groupBy("a", "t").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    found = _cut_small(
        texts.join(places, ["a", "t"]).mapInArrow(lambda b: contexts(b, length, gram), KINDS), "repeats-contexts"
    )
    cuts = _repeats(found, length, gram, crowd).groupBy("a", "t").agg(
        F.collect_list(F.struct("pos", "size")).alias("cuts")
    )
    kind = docs.schema["row"].dataType.simpleString()
    return (
        docs.join(cuts, ["a", "t"], "left")
        .select("row", "text", "cuts")
        .mapInArrow(kept, f"row {kind}, n_bytes long, spans array<struct<start int, end int>>, kept binary")
    )
