"""Removal of repeated byte strings, found by merging Burrows-Wheeler transforms of shards.

A string of LENGTH bytes is removed wherever it also starts earlier, by (doc_id, start). The
work is cut into bounded pieces by content: of the GRAM-byte grams in a window of LENGTH
bytes, the one with the least hash is the window's anchor, so equal windows have equal
anchors at equal offsets. The windows that share an anchor are neighbours and form a
segment, about 30 of them. Equal segments are settled by their hashes, the earliest stays.
Segments that differ around a common anchor form shards, every shard gets its
Burrows-Wheeler transform, and the transforms are merged. Where an anchor has more segments
than one merge should hold, their windows get longer anchors and are cut into segments again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, written

LENGTH = 100
GRAM = 40
STEP = 20
#: Bytes of text that are hashed at a time, of text per bucket of segments, and of segments per merge.
UNIT, BUCKET, MERGE = 2 << 20, 16 << 20, 1 << 19
#: Bytes of whole texts that a task holds beside what stays of them, and of those that it cuts into segments, which may be seven times as long.
WHOLE, CUT = 8 << 20, 2 << 20
#: Distinct segments that one merge takes around an anchor; more are dealt out again by longer grams.
CROWD = 2000
LAST = (1 << 63) - 1  # a null id comes last


def _spread(seed: int, n: int) -> np.ndarray:
    """Fixed odd 64-bit numbers from a seed."""
    return np.frombuffer(hashlib.shake_128(str(seed).encode()).digest(8 * n), "<u8") | np.uint64(1)


LETTER, BASE = _spread(1, 256), _spread(2, 1)[0]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n bytes, by doubling."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    have, width, done, size = LETTER[data], 1, None, 0
    while True:
        if n & width:
            done = have[: len(have)] if done is None else done[: len(done) - width] * _power(width) + have[size : size + len(done) - width]
            size += width
        if width * 2 > n:
            break
        have = have[: len(have) - width] * _power(width) + have[width:]
        width *= 2
    done = done[: len(data) - n + 1]
    done = (done ^ (done >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return done ^ (done >> np.uint64(29))


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each segment of texts that lie end to end (under 2**24 bytes)."""
    grams = gram_hashes(data, gram)
    span = length - gram + 1
    if len(grams) < span:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    least = grams & ~np.uint64((1 << 24) - 1) | np.arange(len(grams), dtype=np.uint64)  # the first of equals
    width, have = 1, least
    while width * 2 <= span:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    have = np.minimum(have[: len(least) - span + 1], have[span - width : span - width + len(least) - span + 1])
    anchor = (have & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(anchor) + 1, np.int64)
    whole = ends - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    first = valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]))
    first[starts[whole]] = True
    at = np.flatnonzero(first)
    count = np.add.reduceat(valid.astype(np.int64), at) if len(at) else at
    return at, count, grams[anchor[at]]


class Rows:
    """Segments as columns, packed for a shuffle: hashes as they are, the rest compressed."""

    KINDS = (("doc", "<i8"), ("tag", "<u4"), ("start", "<i4"), ("count", "<i4"))

    @staticmethod
    def pack(columns: dict[str, np.ndarray], at: np.ndarray) -> bytes:
        rest = b"".join(columns[c][at].astype(kind).tobytes() for c, kind in Rows.KINDS)
        return b"".join((len(at).to_bytes(8, "little"), columns["anchor"][at].astype("<u8").tobytes(), columns["hash"][at].astype("<u8").tobytes(), zstandard.ZstdCompressor(1).compress(rest)))

    @staticmethod
    def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
        out: dict[str, list] = {c: [] for c in ("anchor", "hash", "doc", "tag", "start", "count")}
        for blob in blobs:
            n = int.from_bytes(blob[:8], "little")
            out["anchor"].append(np.frombuffer(blob, "<u8", n, 8))
            out["hash"].append(np.frombuffer(blob, "<u8", n, 8 + 8 * n))
            rest, at = zstandard.ZstdDecompressor().decompress(blob[8 + 16 * n :]), 0
            for c, kind in Rows.KINDS:
                out[c].append(np.frombuffer(rest, kind, n, at))
                at += n * np.dtype(kind).itemsize
        return {c: np.concatenate(x) for c, x in out.items()}


def _classes(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (anchor, hash, doc, start), and which of them are not the earliest of their class.

    Rows of the same doc and start are the same place, and none is earlier."""
    order = np.lexsort((c["start"], c["doc"], c["hash"], c["anchor"]))
    a, h, d, s = (c[k][order] for k in ("anchor", "hash", "doc", "start"))
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (d != d[lead]) | (s != s[lead])


def _by_doc(c: dict[str, np.ndarray], at: np.ndarray, kind: int, columns: tuple) -> Iterator[tuple]:
    """(doc, tag, kind, bytes of the columns, row by row) for each document of the rows ``at``."""
    if not len(at):
        return
    at = at[np.lexsort((c["tag"][at], c["doc"][at]))]
    doc, tag = c["doc"][at], c["tag"][at]
    table = np.stack([np.asarray(x[at]).astype("<i8") for x in columns], axis=1)
    cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(doc[a]), int(tag[a]), kind, table[a:b].tobytes()


COVER, REP, CROWDED = 0, 1, 2
NOTES = "bucket int, doc long, tag long, kind int, data binary"


def _notes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "doc", "tag", "kind", "data"])


def tag_of(data: bytes) -> int:
    """Tells texts of the same id apart: 32 bits of the XXH64 that Spark's xxhash64 gives."""
    return xxhash.xxh64_intdigest(data, 42) & 0xFFFFFFFF


def _whole_texts(length: int):
    """Over texts: (doc, tag, start, bytes) of parts that have every window of ``length`` bytes once."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(batches):
            docs = batch.column("id").fill_null(LAST).to_pylist()
            for doc, text in zip(docs, batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if len(data) < length:
                    continue
                tag = tag_of(data)
                for at in range(0, len(data) - length + 1, UNIT):
                    yield doc, tag, at, data[at : at + UNIT + length - 1]

    return parts


def _listed(name: str, length: int):
    """Over texts with lists of segments: (doc, tag, start, bytes) of each segment of the list ``name``."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(batches):
            for doc, tag, text, listed in zip(*(batch.column(n).to_pylist() for n in ("doc", "tag", "text", name)), strict=True):
                for _, start, count in np.frombuffer(b"".join(listed or ()), "<i8").reshape(-1, 3).tolist():
                    yield doc, tag, start, text[start : start + count + length - 1]

    return parts


def _find_segments(buckets: int, length: int, gram: int, parts):
    """Over parts of texts: the segments that are the earliest of their class in their batch, by bucket, and what the others cover."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, size = [], 0
        for part in parts(batches):
            held.append(part)
            size += len(part[3])
            if size >= UNIT:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            joined = b"".join(u[3] for u in unit)
            data = np.frombuffer(joined, np.uint8)
            ends = np.cumsum([len(u[3]) for u in unit])
            first, count, anchor = segments(data, ends, length, gram)
            of = np.searchsorted(ends, first, side="right")
            digest = xxhash.xxh3_64_digest
            hashes = b"".join([digest(joined[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)])
            begin = np.concatenate(([0], ends[:-1]))
            c = {
                "anchor": anchor, "hash": np.frombuffer(hashes, ">u8").astype("<u8"), "count": count, "doc": np.array([u[0] for u in unit], np.int64)[of],
                "tag": np.array([u[1] for u in unit], np.int64)[of], "start": first - begin[of] + np.array([u[2] for u in unit], np.int64)[of],
            }
            order, later = _classes(c)
            rows = [(int(d % buckets), d, t, k, x) for d, t, k, x in _by_doc(c, order[later], COVER, (c["start"], c["start"] + c["count"] + length - 1))]
            stay = np.sort(order[~later])
            bucket = (c["anchor"][stay] >> np.uint64(24)) % np.uint64(buckets)
            turn = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[turn]) != 0, [True])))
            rows += [(int(bucket[turn[a]]), None, None, REP, Rows.pack(c, stay[turn[a:b]])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
            yield _notes(rows)

    return run


def _settle(length: int, crowd: int):
    """Over the notes of a bucket: what segments that are not the earliest of their class cover, and the segments still to compare, by document."""

    def settle(blobs: list[bytes], bucket: int) -> list[tuple]:
        c = Rows.unpack(blobs)
        order, later = _classes(c)
        out = [(bucket, *x) for x in _by_doc(c, order[later], COVER, (c["start"], c["start"] + c["count"].astype(np.int64) + length - 1))]
        a, h = c["anchor"][order], c["hash"][order]
        lead = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1]))))
        anchors = a[lead]
        new = np.concatenate(([True], anchors[1:] != anchors[:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(lead)))[np.cumsum(new) - 1]
        for kind, which in ((REP, (size > 1) & (size <= crowd)), (CROWDED, size > crowd)):
            out += [(bucket, *x) for x in _by_doc(c, order[lead[which]], kind, (c["anchor"].view(np.int64), c["start"], c["count"]))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            passed = []
            for bucket, doc, tag, kind, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if kind == COVER:
                    passed.append((bucket, doc, tag, kind, data))
                    continue
                if bucket != now and held:
                    passed += settle(held, now)
                    held = []
                now = bucket
                held.append(data)
            yield _notes(passed)
        if held:
            yield _notes(settle(held, now))

    return run


# --- merging Burrows-Wheeler transforms --------------------------------------------------


class Shard:
    """The Burrows-Wheeler transform of some strings of symbols, each with an end mark of its own.

    symbols: positive integers of all strings, end to end; ends: where each string ends. Row
    r of the transform is a suffix, in sorted order; the end marks come first, by string.
    ``bwt[r]`` is the symbol before that suffix, 0 for the first of a string; ``place[r]`` is
    where in ``symbols`` the suffix starts, -1 for an end mark.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n, m = len(symbols), len(ends)
        begin = np.concatenate(([0], ends[:-1])) if m else ends
        of = np.searchsorted(ends, np.arange(n), side="right")
        stop = ends[of] if n else ends
        # Sort suffixes by prefix doubling; running into the end mark of string s ranks as s, below all symbols.
        rank, step = symbols.astype(np.int64) + m, 1
        _, rank = np.unique(rank, return_inverse=True)
        rank = rank.astype(np.int64) + m
        longest = int((ends - begin).max(initial=0))
        while step <= longest:
            after = np.arange(n) + step
            nxt = np.where(after < stop, rank[np.minimum(after, n - 1)], np.where(after == stop, of, -1)) if n else after
            _, rank = np.unique(rank * (n + 2 * m + 2) + nxt + 1, return_inverse=True)
            rank = rank.astype(np.int64) + m
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.place = np.concatenate((np.full(m, -1), order))
        before = np.where(np.isin(order, begin), 0, symbols[order - 1]) if n else order
        last = np.where(ends > begin, symbols[ends - 1], 0) if n else np.zeros(m, np.int64)
        self.bwt = np.concatenate((last, before)).astype(np.int64)
        self.strings = m


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the transforms of shards: (shard, row in it, block) of each merged row, right for the first ``depth`` symbols.

    Refinement by iteration: at first only the end marks are in place. When the rows are in
    order by their first d symbols, the symbol before each row, taken in this order, puts the
    rows in order by d + 1 symbols; no suffix is sorted or even read. Every shard's rows
    come in their own order, so the interleave alone tells which row of which shard is meant.
    Rows of a block have a common prefix of at least d symbols: two rows stay in one block
    if their first symbols are equal and the rows they come from were in one block.
    A block of more than one row at the end is an interval of a repeated string.
    """
    marks = sum(s.strings for s in shards)
    total = sum(len(s.bwt) for s in shards)
    head = np.repeat(np.arange(len(shards)), [s.strings for s in shards])
    tail = np.repeat(np.arange(len(shards)), [len(s.bwt) - s.strings for s in shards])
    shard = np.concatenate((head, tail))
    block = np.zeros(total, np.int64)  # all rows share the empty prefix
    bwt = np.concatenate([s.bwt for s in shards])
    base = np.cumsum([0, *[len(s.bwt) for s in shards]])[:-1]

    def row_of(shard: np.ndarray) -> np.ndarray:
        """The row of its shard that each merged row is: how many of the shard came before."""
        order = np.argsort(shard.astype(np.uint16 if len(shards) < 1 << 16 else np.int64), kind="stable")
        sizes = np.bincount(shard, minlength=len(shards))
        row = np.empty(total, np.int64)
        row[order] = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return row

    for _ in range(depth):
        before = bwt[base[shard] + row_of(shard)]
        order = np.argsort(before, kind="stable")
        order = order[before[order] > 0]
        symbol, source = before[order], block[order]
        shard = np.concatenate((head, shard[order]))
        new = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1]))) if len(order) else np.empty(0, bool)
        block = np.concatenate((np.arange(marks), marks + np.cumsum(new) - 1))
    return shard, row_of(shard), block


def repeated_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH, step: int = STEP, shard_bytes: int = MERGE // 4) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes in pieces of text that also start earlier: (piece, offset).

    A piece is part of a document ``doc`` from byte ``start``. Its symbols are the runs of
    ``step`` bytes from every byte on, known by their 64-bit hashes; the strings of a piece
    are its symbols at every step-th byte, for each of the first ``step`` bytes. So a window
    of ``length`` bytes is one of length / step symbols.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    base = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data, step)
    many = np.maximum(0, sizes - step + 1)
    of = np.repeat(np.arange(len(pieces)), many)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    _, symbol = np.unique(hashes[base[of] + offset], return_inverse=True)
    symbol = symbol + 1
    part = np.cumsum(sizes) // shard_bytes
    shards, places = [], []
    for k in np.unique(part):
        at = np.flatnonzero(part[of] == k)
        at = at[np.lexsort((offset[at], offset[at] % step, of[at]))]
        last = np.flatnonzero(np.append((of[at][1:] != of[at][:-1]) | (offset[at][1:] != offset[at][:-1] + step), True)) if len(at) else at
        shards.append(Shard(symbol[at], last + 1))
        places.append(np.append(at, -1))
    if not shards:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shard, row, block = merge(shards, length // step)
    first = np.cumsum([0, *[len(p) for p in places]])[:-1]
    where = np.concatenate([np.where(s.place >= 0, s.place, len(p) - 1) for s, p in zip(shards, places, strict=True)])
    rows_first = np.cumsum([0, *[len(s.place) for s in shards]])[:-1]
    at = np.concatenate(places)[first[shard] + where[rows_first[shard] + row]]
    size = np.bincount(block)
    many_ = (size[block] > 1) & (at >= 0)
    at, block = at[many_], block[many_]
    at_doc, at_start = doc[of[at]], start[of[at]] + offset[at]
    order = np.lexsort((at_start, at_doc, block))
    at, block, at_doc, at_start = at[order], block[order], at_doc[order], at_start[order]
    new = np.concatenate(([True], block[1:] != block[:-1])) if len(at) else np.empty(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (at_doc != at_doc[lead]) | (at_start != at_start[lead])
    return of[at[later]], offset[at[later]]


def _merge_groups(length: int):
    """Over segments sorted by anchor: what their repeated windows cover, anchors being kept whole."""

    def covers(rows: list[tuple]) -> pa.RecordBatch:
        doc = np.array([r[1] for r in rows], np.int64)
        start = np.array([r[3] for r in rows], np.int64)
        piece, offset = repeated_windows([r[4] for r in rows], doc, start, length)
        c = {"doc": doc[piece], "tag": np.array([r[2] for r in rows], np.int64)[piece], "from": start[piece] + offset}
        return _notes([(0, *x) for x in _by_doc(c, np.arange(len(piece)), COVER, (c["from"], c["from"] + length))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = [], 0, ("anchor", "doc", "tag", "start", "bytes")
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if size >= MERGE and row[0] != held[-1][0]:
                    yield covers(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield covers(held)

    return run


# --- whole documents ---------------------------------------------------------------------


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) spans; those that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], axis=1)


def cut_out(data: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(data[at:a])
        at = b
    return b"".join((*out, data[at:]))


def longer_grams(length: int, gram: int) -> list[int]:
    """By which grams crowded windows are dealt again; around the last one, the window itself, no segments differ."""
    half = (length + gram) // 2
    return [half, (length + half) // 2, length]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def _result(data: bytes, runs: np.ndarray, keep: bool) -> tuple:
    kept = cut_out(data, runs)
    return (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs.tolist()], kept if keep else None)


def _result_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]


RESULT_NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]


def _spans(blobs: list[bytes] | None) -> np.ndarray:
    return union(np.frombuffer(b"".join(blobs or ()), "<i8").reshape(-1, 2))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), length: int = LENGTH, gram: int = GRAM, keep: bool = True, crowd: int = CROWD) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) and the carried columns.

    Texts are UTF-8 bytes, null ones empty. A byte goes if a string of ``length`` bytes over
    it also starts earlier in the input: in a document of smaller id, or earlier in the same
    one; overlaps count, and matches lie within documents. spans are the maximal removed
    runs, kept is the rest put together (null with keep=False). length is a multiple of 20.

    Rows of the same id are parts of one document that lie over each other: of two equal
    strings at the same start neither is earlier. A null id counts as the largest. An empty
    table gives an empty one; columns that are not carried are not read.

    Texts are read three times and moved once, with the notes on them; those with segments to
    compare byte for byte are moved once more. Copies within a batch of texts are settled
    there, so a common passage costs a row for each batch and not for each document. Around
    an anchor with over ``crowd`` different segments the windows are cut again by longer grams
    (half of what a window lacks, half of that, the whole window), and these segments are
    settled and merged as the others are. Their texts are moved once for each such round.
    """
    spark = docs.sparkSession
    names = [f"c{k}" for k in range(len(carry))]
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET))

    def settled(texts: DataFrame, parts, gram: int) -> DataFrame:
        found = texts.mapInArrow(_find_segments(buckets, length, gram, parts), NOTES)
        found = found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(length, crowd), NOTES)
        return written(found, "settled").select("doc", "tag", "kind", "data")

    def listed(notes: DataFrame, *kinds: tuple[int, str]) -> DataFrame:
        return notes.groupBy("doc", "tag").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("data"))).alias(n) for k, n in kinds])

    notes = settled(picked.select("id", "text"), _whole_texts(length), gram)
    lists = listed(notes, (COVER, "covers"), (REP, "reps"), (CROWDED, "crowd"))
    keyed = picked.withColumn("doc", F.coalesce("id", F.lit(LAST))).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)))
    joined = keyed.join(lists, ["doc", "tag"], "left")
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*names).schema)
    shape = f"id long, {carried + ', ' if carried else ''}doc long, tag long, text binary, covers array<binary>, reps array<binary>, crowd array<binary>, {RESULT}"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=WHOLE):
            open_ = [bool(r or c) for r, c in zip(batch.column("reps").to_pylist(), batch.column("crowd").to_pylist(), strict=True)]
            data = [(t or "").encode() for t in batch.column("text").to_pylist()]
            runs = [_spans(b) for b in batch.column("covers").to_pylist()]
            results = [(None,) * 6 if o else _result(d, r, keep) for o, d, r in zip(open_, data, runs, strict=True)]
            lists_ = [pa.array([x if o else None for o, x in zip(open_, batch.column(n).to_pylist(), strict=True)], pa.list_(pa.binary())) for n in ("reps", "crowd")]
            covers_ = pa.array([[r.astype("<i8").tobytes()] if o else None for o, r in zip(open_, runs, strict=True)], pa.list_(pa.binary()))
            columns = [batch.column("id"), *[batch.column(n) for n in names], batch.column("doc"), batch.column("tag"), pa.array([d if o else None for o, d in zip(open_, data, strict=True)], pa.binary()), covers_, *lists_]
            yield pa.RecordBatch.from_arrays([*columns, *_result_columns(results)], ["id", *names, "doc", "tag", "text", "covers", "reps", "crowd", *RESULT_NAMES])

    passed = written(joined.select("id", *names, "doc", "tag", "text", "covers", "reps", "crowd").mapInArrow(first_pass, shape), "first_pass")
    open_docs = passed.where("text is not null").select("id", *names, "doc", "tag", "text", "covers", "reps", "crowd")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=CUT):
            rows = []
            for doc, tag, text, reps in zip(*(batch.column(n).to_pylist() for n in ("doc", "tag", "text", "reps")), strict=True):
                for anchor, start, count in np.frombuffer(b"".join(reps or ()), "<i8").reshape(-1, 3).tolist():
                    rows.append((anchor, doc, tag, start, text[start : start + count + length - 1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "doc", "tag", "start", "bytes"])

    def pieces_of(texts: DataFrame) -> DataFrame:
        return texts.where("size(reps) > 0").select("doc", "tag", "text", "reps").mapInArrow(cut, "anchor long, doc long, tag long, start long, bytes binary")

    pieces, covered = pieces_of(open_docs), None
    crowded = open_docs.where("size(crowd) > 0").select("doc", "tag", "text", "crowd")
    for longer in longer_grams(length, gram):
        if crowded.isEmpty():
            break
        notes = settled(crowded, _listed("crowd", length), longer)
        covers = notes.where(F.col("kind") == COVER).select("doc", "tag", "data")
        covered = covers if covered is None else covered.union(covers)
        open_lists = listed(notes.where(F.col("kind") != COVER), (REP, "reps"), (CROWDED, "crowd"))
        again = written(crowded.select("doc", "tag", "text").join(open_lists, ["doc", "tag"]), "crowded")
        pieces = pieces.union(pieces_of(again))
        crowded = again.where("size(crowd) > 0").select("doc", "tag", "text", "crowd")
    merged = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc", "start").mapInArrow(_merge_groups(length), NOTES).select("doc", "tag", "data")
    if covered is not None:
        merged = merged.union(covered)
    more = merged.groupBy("doc", "tag").agg(F.collect_list("data").alias("more"))

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=WHOLE):
            results = [_result(t, _spans((c or []) + (m or [])), keep) for t, c, m in zip(*(batch.column(n).to_pylist() for n in ("text", "covers", "more")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[batch.column(n) for n in names], *_result_columns(results)], ["id", *names, *RESULT_NAMES])

    rest = open_docs.select("id", *names, "doc", "tag", "text", "covers").join(more, ["doc", "tag"], "left").select("id", *names, "text", "covers", "more")
    rest = rest.mapInArrow(last_pass, f"id long, {carried + ', ' if carried else ''}{RESULT}")
    out = passed.where("text is null").select("id", *names, *RESULT_NAMES).union(rest)
    return out.select(F.col("id").alias("doc_id"), *RESULT_NAMES, *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the repeats of 100 bytes or more."""
    return remove_repeats(documents(spark, sf_dir), keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
