"""Packing documents into sequences of a fixed length by swap-based local search."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts_of, written
from .vocab import crc32, encoder

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 1024
END = 2
#: Pieces that one task packs among themselves.
GROUP = 20_000


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: (doc_id, piece, start, length, ids_crc32).

    A document is the ids of its text and then ``end_id``. One of more than ``length`` ids is
    cut into pieces of ``length``, the first of which is shorter if the ids don't divide. A
    null or empty text is its end id alone.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = np.append(encode(text), np.uint32(end_id))
                first = len(ids) % length or min(length, len(ids))
                cuts = [0, *range(first, len(ids) + 1, length)]
                rows += [(doc, k, a, b - a, crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of items, with the underfull ones ready by free room, for local search."""

    def __init__(self, sizes: list[int], room: int):
        self.sizes, self.room = sizes, room
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.bin = [0] * len(sizes)

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin that it fits in."""
        open_: list[list[int]] = [[] for _ in range(self.room + 1)]  # bins by free room
        frees: list[int] = []
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[i]
            at = bisect_left(frees, size)
            if at == len(frees):
                b = len(self.items)
                self.items.append([])
                self.fill.append(0)
            else:
                free = frees[at]
                b = open_[free].pop()
                if not open_[free]:
                    frees.pop(at)
            self.items[b].append(i)
            self.fill[b] += size
            self.bin[i] = b
            free = self.room - self.fill[b]
            if free:
                if not open_[free]:
                    insort(frees, free)
                open_[free].append(b)

    def search(self) -> None:
        """Local search among the underfull bins, until a pass takes no step.

        In a pass every underfull bin, the fullest first, takes from the bins that are
        emptier than it: it is given an item or two, or gives one or two smaller ones for
        them, always by the step that makes it fullest. What it gives goes to a bin it takes
        from that has room for it (of two, the fuller). Only steps that raise the sum of
        squared fills are taken, so the search ends; bins that lose their last item are
        dropped.
        """
        moved = True
        while moved:
            moved = False
            under = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.room), key=lambda b: (-self.fill[b], b))
            self.pool: list[set[int]] = [set() for _ in range(self.room + 1)]
            self.mask = 0
            for b in under:
                for i in self.items[b]:
                    self._offer(i)
            for b in under:
                for i in self.items[b]:
                    self._withdraw(i)
                while 0 < self.fill[b] < self.room and (self._fill_up(b, True) or self._fill_up(b, False)):
                    moved = True
        keep = [b for b in range(len(self.items)) if self.items[b]]
        self.items, self.fill = [self.items[b] for b in keep], [self.fill[b] for b in keep]

    def _offer(self, i: int) -> None:
        self.pool[self.sizes[i]].add(i)
        self.mask |= 1 << self.sizes[i]

    def _withdraw(self, i: int) -> None:
        at = self.pool[self.sizes[i]]
        at.discard(i)
        if not at:
            self.mask &= ~(1 << self.sizes[i])

    def _single(self, most: int) -> tuple[int, ...]:
        """The largest size on offer of at most ``most``."""
        low = self.mask & ((1 << (most + 1)) - 1)
        return (low.bit_length() - 1,) if low else ()

    def _double(self, most: int, least: int) -> tuple[int, ...]:
        """Two sizes on offer with the largest sum of at most ``most`` and over ``least``."""
        found, top = (), least
        low = self.mask & ((1 << (most // 2 + 1)) - 1)
        while low:
            a = low.bit_length() - 1
            low ^= 1 << a
            rest = self.mask & ((1 << (most - a + 1)) - 1)
            if len(self.pool[a]) < 2:
                rest &= ~(1 << a)
            if rest and a + rest.bit_length() - 1 > top:
                found, top = (rest.bit_length() - 1, a), a + rest.bit_length() - 1
                if top == most:
                    break
        return found

    def _fill_up(self, b: int, doubles: bool) -> bool:
        """One step for bin b, the one that leaves it fullest (with or without two items coming). False if there is none that the others have room for and that raises the sum of squares."""
        free, sizes, mine = self.room - self.fill[b], self.sizes, self.items[b]
        by_size = {sizes[i]: i for i in mine}
        gives: dict[int, tuple[int, ...]] = {0: ()}
        for s, i in by_size.items():
            gives.setdefault(s, (i,))
        best, gain = None, 0
        for s, out in gives.items():
            coming = self._single(s + free)
            if coming and coming[0] - s > gain:
                best, gain = (out, coming), coming[0] - s
        if gain < free and doubles:
            for s, out in gives.items():
                coming = self._double(s + free, s + gain)
                if coming:
                    best, gain = (out, coming), sum(coming) - s
                    if gain == free:
                        break
        if gain < free:
            for x in range(len(mine)):
                for y in range(x):
                    s = sizes[mine[x]] + sizes[mine[y]]
                    coming = self._single(s + free)
                    if coming and coming[0] - s > gain:
                        best, gain = ((mine[y], mine[x]), coming), coming[0] - s
        if best is None:
            return False
        out, coming = best
        taken: list[int] = []
        for s in coming:
            i = min(self.pool[s], key=lambda i: (self.fill[self.bin[i]], i))
            self._withdraw(i)
            taken.append(i)
        givers = sorted({self.bin[i] for i in taken}, key=lambda g: (-self.fill[g], g))
        after = {g: self.fill[g] - sum(sizes[i] for i in taken if self.bin[i] == g) for g in givers}
        back = sum(sizes[i] for i in out)
        to = next((g for g in givers if after[g] + back <= self.room), None)
        if to is not None:
            after[to] += back
        if to is None or (self.fill[b] + gain) ** 2 + sum(x * x for x in after.values()) <= self.fill[b] ** 2 + sum(self.fill[g] ** 2 for g in givers):
            for i in taken:
                self._offer(i)
            return False
        for i in taken:
            self._put(i, b)
        for i in out:
            self._put(i, to)
            self._offer(i)
        return True

    def _put(self, i: int, b: int) -> None:
        old = self.bin[i]
        self.items[old].remove(i)
        self.fill[old] -= self.sizes[i]
        self.items[b].append(i)
        self.fill[b] += self.sizes[i]
        self.bin[i] = b


def pack_sizes(sizes: list[int], room: int) -> tuple[list[list[int]], list[int]]:
    """Bins of item numbers, and their fills. Items of size ``room`` have bins of their own; sizes are 1 to ``room``."""
    bins = Bins(sizes, room)
    bins.best_fit()
    bins.search()
    return bins.items, bins.fill


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Place pieces (with a column ``length``) in sequences: their columns, sequence_id and offset.

    cut: a written table of pieces. Pieces are dealt out evenly to tasks of about ``group``
    pieces, whatever their documents or sizes, and each task packs its own: a task leaves at
    most about one sequence that is not full, among thousands. Sequence ids hold the task's
    number, so they are unique. Within a sequence, offsets run from 0 without gaps. Repeated
    pieces are pieces of their own. An empty table gives an empty one.
    """
    parts = max(1, math.ceil(cut.count() / group))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = list(frames)
        if not got:
            return
        all_ = pd.concat(got, ignore_index=True)
        sizes = all_["length"].tolist()
        items, _ = pack_sizes(sizes, length)
        number = np.repeat(np.arange(len(items)), [len(x) for x in items])
        at = np.array([i for x in items for i in x], np.int64)
        ends = np.cumsum(np.array(sizes, np.int64)[at])
        first = np.searchsorted(number, number)
        offset = ends - np.array(sizes, np.int64)[at]
        offset -= offset[first]
        out = all_.iloc[at].reset_index(drop=True)
        out["sequence_id"] = number + (TaskContext.get().partitionId() << 32)
        out["offset"] = offset
        yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return cut.repartition(parts).mapInPandas(run, schema)


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null texts count as empty, null ids keep their rows, repeated rows are packed as often
    as they are there, other columns are not read, and texts are never cut short.
    """
    cut = written(pieces(docs, tokenizer or public_tokenizers.path(TOKENIZER), length, end_id, id_col, text_col), "pieces")
    return pack(cut, length, group)


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    return packed(documents(spark, sf_dir))


QUERIES = {"op8_swap_packing": op8_swap_packing}
ORACLES: dict[str, str] = {}
