"""Packing token pieces into windows by multiway differencing."""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import common as C
from tidewire.session import cut

# ASCII punctuation around one run of other characters.
MARKED = re.compile(r"([!-/:-@\[-`{-~]*)([^\s!-/:-@\[-`{-~]+)([!-/:-@\[-`{-~]*)")
# The same around letters alone.
APART = r"^(?P<before>[!-/:-@\[-`{-~]*)(?P<stem>\pL+)(?P<behind>[!-/:-@\[-`{-~]*)$"
# Pieces that are packed together, on average.
BATCH = 256
# Bytes that a worker may hold in words and their ids, and what an entry takes beside them; when there
# are more, it starts anew.
CACHE, ENTRY = 192 << 20, 200
# Characters of text that are tokenized at once.
CHUNK = 1_000_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Token ids of words, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer lowers case and never joins words across white space, nor letters and the
    punctuation around them.  So texts are tokenized word by word, letters and marks apart, and
    what a worker still holds is not tokenized again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks: dict[str, bytes] = {"": b""}
        self.held, self.most = 0, CACHE
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def hold(self, found: dict[bytes, bytes]) -> None:
        self.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def forget(self) -> None:
        self.clear()
        self.marks, self.held = {"": b""}, 0

    def one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Tokenize new words; letters many words at a time, cut where a token ends a word."""
        apart, alone, plain = {}, [], set()
        for w in words:
            text = w.decode()
            if text.isascii() and text.isalpha():
                plain.add(w)
                continue
            # A lone apostrophe may be joined to the letters behind it, as in 's.
            m = MARKED.fullmatch(text)
            if m and m[2].lower().isalpha() and m[1] != "'" and not any(map(text.__contains__, self.special)):
                apart[w] = m.groups()
            else:
                alone.append(w)
        plain.update(m[1].encode() for m in apart.values())
        stems = [w for w in plain if w not in self]
        for at in range(0, len(stems), 2000):
            part = stems[at : at + 2000]
            got = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(got[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, bounds = ids.tobytes(), (4 * ends).tolist()
                self.hold(dict(zip(part, map(raw.__getitem__, map(slice, [0, *bounds], bounds)))))
            else:
                alone += part
        self.hold({w: self.one(w) for w in alone})
        marked = [(w, self.mark(before), self[stem.encode()], self.mark(behind)) for w, (before, stem, behind) in apart.items()]
        self.hold({w: before + ids + behind for w, before, ids, behind in marked if before or behind})

    def mark(self, run: str) -> bytes:
        if run not in self.marks:
            self.marks[run] = self.one(run.encode())
            self.held += len(run) + len(self.marks[run]) + ENTRY
        return self.marks[run]

    def of(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Each text's ids.  A word is looked up once, however often the texts hold it."""
        if self.held > self.most:
            self.forget()
        # A slice of a batch is copied: widening its offsets in place has given wrong bytes.
        listed = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        texts = pa.array([(t or "").encode("utf-8", "replace") for t in listed], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        ids, sizes = self.unlike(coded.dictionary)
        ids = ids.take(coded.indices).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return np.split(ids, upto[ends[1:-1]]) if len(texts) else []

    def unlike(self, words: pa.Array) -> tuple[pa.LargeListArray, np.ndarray]:
        """Ids of different words and how many; letters and the marks around them are looked up apart."""
        parts = pc.extract_regex(words, APART)
        before, stem, behind = (pc.struct_field(parts, [i]).fill_null("") for i in range(3))
        whole = pc.or_(pc.is_null(parts), pc.or_(pc.equal(before, "'"), pc.match_substring(words, "\u0130")))
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(words, token))
        empty = pa.scalar("", pa.large_string())
        pieces = [
            pc.if_else(whole, empty, before).dictionary_encode(),
            pc.if_else(whole, words, stem).dictionary_encode(),
            pc.if_else(whole, empty, behind).dictionary_encode(),
        ]
        found, codes = [], []
        for i, piece in enumerate(pieces):
            codes.append(piece.indices.to_numpy() + len(found))
            found += self.looked_up(piece.dictionary, i != 1)
        each = _lists(found)
        ids = each.take(pa.array(np.stack(codes, axis=1).ravel()))
        sizes = pc.list_value_length(ids).to_numpy().reshape(-1, 3).sum(axis=1)
        return pa.LargeListArray.from_arrays(_ends(sizes), ids.flatten()), sizes

    def looked_up(self, words: pa.Array, marks: bool) -> list[bytes]:
        if marks:
            return list(map(self.mark, words.to_pylist()))
        words = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, words))
        # White space at the ends of a text gives empty words.
        new = {w for w, ids in zip(words, found, strict=True) if ids is None and w}
        if new:
            self.learn(new)
            found = [ids if ids is not None or not w else self[w] for w, ids in zip(words, found, strict=True)]
        return [ids or b"" for ids in found]


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())


def _lists(found: list[bytes]) -> pa.LargeListArray:
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return pa.LargeListArray.from_arrays(_ends(sizes), pa.array(np.frombuffer(b"".join(found), "<u4")))


def cuts(total: int, window: int, tail: int) -> list[int]:
    """Lengths of a document's pieces: whole windows, then a rest in parts of about equal length."""
    whole, rest = divmod(total, window)
    parts = -(-rest // tail)
    return [window] * whole + [rest // parts + (i < rest % parts) for i in range(parts)]


@functools.cache
def word_ids(path: str) -> WordIds:
    """A worker's one instance: what a task has learnt serves the next."""
    return WordIds(path)


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``CHUNK`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK)))
        yield batch.slice(at, to - at)
        at = to


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: the two partial partitions of largest spread are merged, the heavy ways of
    one with the light ways of the other, until one is left.  Gives the items of each way."""
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(ways, dtype=np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [(i,)] + [()] * (ways - 1)))
    heapq.heapify(heap)
    for serial in range(len(sizes), 2 * len(sizes) - 1):
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        items = [(x, y) if x and y else x or y for x, y in zip(in_a, reversed(in_b), strict=True)]
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, [items[i] for i in order]))
    out = []
    for tree in heap[0][3]:
        flat, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                flat.append(x)
        out.append(sorted(flat))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each window, none above the capacity.  The count starts at what the sum needs and
    rises whenever a window would exceed the capacity."""
    if not sizes:
        return []
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        over = max(sum(sizes[i] for i in p) for p in parts)
        if over <= capacity:
            return [p for p in parts if p]
        ways += 1


def pack(
    df: DataFrame,
    text: str,
    tokenizer: str,
    window: int = 2048,
    tail: int = 512,
    end_id: int = 1,
    ids: bool = False,
    carry: list[str] | None = None,
    seed: int = 20_240_131,
    cache: int = CACHE,
) -> DataFrame:
    """One row per piece: the columns ``carry`` of ``df`` (all) in the struct ``row``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked, the piece's ``ids``.

    A row's ids end with ``end_id``.  Whole windows of a long text stand alone; the rest is cut
    into parts of at most ``tail`` ids, which are packed in hashed batches of about 256 by
    differencing.  Null and empty texts have the end id alone; repeated rows are packed each.
    ``tokenizer`` is the path of the vocabulary file on every machine.  A worker holds the ids of words in
    ``cache`` bytes; fewer take longer and change nothing else.
    """
    own = ["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids
    row = C.packed(df.select(*[C.col(c) for c in carry or df.columns]))
    frame = df.select(row, C.row_key(df, seed).alias("k"), C.col(text).alias("text"))
    schema = T.StructType(
        frame.schema.fields[:2]
        + [T.StructField(c, T.ArrayType(T.LongType()) if c == "ids" else T.LongType()) for c in own]
    )

    def tokenize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        words.most = cache
        for whole in batches:
            for batch in chunks(whole):
                at, cols = [], {c: [] for c in own}
                for i, found in enumerate(words.of(batch.column("text"))):
                    got, start = np.append(found, np.uint32(end_id)).astype("<u4"), 0
                    for n in cuts(len(got), window, tail):
                        piece = got[start : start + n]
                        values = (start, n, zlib.crc32(piece.tobytes()), len(got), piece)
                        for c, v in zip(own, values, strict=False):
                            cols[c].append(v)
                        at.append(i)
                        start += n
                rows = batch.select(["row", "k"]).take(pa.array(at, pa.int64()))
                made = [pa.array(cols[c], pa.list_(pa.int64()) if c == "ids" else pa.int64()) for c in own]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=["row", "k", *own])

    pieces = cut(frame.mapInArrow(tokenize, schema), "pack-pieces")
    batches = max(1, -(-pieces.count() // BATCH))
    keyed = pieces.withColumn(
        "batch", F.pmod(F.xxhash64(F.lit(seed + 1), "k", "start"), F.lit(batches)).cast("long")
    )

    added = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "start", "length"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        short = [i for i, n in enumerate(sizes) if n < window]
        groups = [[i] for i, n in enumerate(sizes) if n == window]
        groups += [[short[j] for j in g] for g in windows([sizes[i] for i in short], window)]
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, group in enumerate(groups):
            at = 0
            for i in group:
                sequence[i], offset[i] = (int(key[0]) << 24) + w, at
                at += sizes[i]
        return rows.assign(sequence_id=sequence, offset=offset).drop(columns="batch")

    return keyed.groupBy("batch").applyInPandas(place, T.StructType(schema.fields + added))
