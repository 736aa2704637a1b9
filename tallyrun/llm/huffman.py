"""Token-id files in canonical, length-limited Huffman code, with checkpoints for independent decoding.

A file has a range of documents in ascending id order. Its bytes, integers little-endian:

    magic "THF1"; vocabulary size, block size, documents, ids (uint64 each)
    code lengths, one byte per id of the vocabulary
    per document: document id (int64), number of ids (uint64)
    per block: the bit at which it starts (uint64), and after the last the bit at which it ends
    the codes, most significant bit first, in whole bytes

A block is ``block size`` ids (the last one fewer), across documents. Codes are canonical,
by length and id, so the lengths are the whole codebook. Each block is decoded from its
checkpoint without the ones before it, by a table over the next ``MOST_BITS`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, slices, texts_of, written
from .vocab import crc32, encoder

TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"THF1"
MOST_BITS = 18
BLOCK = 4096
END = 0
#: Ids in a file, about: what one task codes or decodes at a time.
FILE_IDS = 2_000_000


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths (uint8) of an optimal prefix code of at most ``most`` bits, by package-merge; 0 for ids that don't occur.

    A level is the sorted ids joined with pairs of the level before. The 2n - 2 lightest of
    the last level are taken: each id in them gets a bit, and the pairs are opened in the
    level before. A single id has length 1.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of more than {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    is_id, level = [], weights
    for _ in range(most):
        is_id.append(np.ones(n, bool) if not is_id else np.concatenate((np.ones(n, bool), np.zeros(len(pairs), bool)))[order])
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate((weights, pairs))
        order = np.argsort(joined, kind="stable")
        level = joined[order]
    take = 2 * n - 2
    for flags in reversed(is_id):
        ids = int(flags[:take].sum())
        lengths[used[:ids]] += 1
        take = 2 * (take - ids)
    return lengths


@lru_cache(maxsize=4)
def _codes(lengths: bytes) -> np.ndarray:
    """The canonical code of each id: by length, then id."""
    size = np.frombuffer(lengths, np.uint8).astype(np.int64)
    order = np.lexsort((np.arange(len(size)), size))
    order = order[size[order] > 0]
    codes = np.zeros(len(size), np.uint64)
    if len(order):
        step = np.left_shift(1, MOST_BITS - size[order])  # what a code takes of the space of all codes
        codes[order] = (np.concatenate(([0], np.cumsum(step)[:-1])) >> (MOST_BITS - size[order])).astype(np.uint64)
    return codes


@lru_cache(maxsize=4)
def _table(lengths: bytes) -> np.ndarray:
    """For each of the next MOST_BITS bits: id * 32 + length of the code that they start with."""
    size = np.frombuffer(lengths, np.uint8).astype(np.int64)
    order = np.lexsort((np.arange(len(size)), size))
    order = order[size[order] > 0]
    table = np.repeat((order << 5 | size[order]).astype(np.int64), np.left_shift(1, MOST_BITS - size[order]))
    return np.concatenate((table, np.zeros((1 << MOST_BITS) - len(table), np.int64))).astype(np.int32)


def encode_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: bytes, block: int = BLOCK) -> bytes:
    """The bytes of a file with these documents."""
    size = np.frombuffer(lengths, np.uint8).astype(np.int64)[ids]
    if len(ids) and not size.min():
        raise ValueError("an id has no code")
    ends = np.cumsum(size)
    start = ends - size
    total = int(ends[-1]) if len(ids) else 0
    # A code of up to 18 bits at any bit lies within two 32-bit words; codes of a word are added up, for their bits differ.
    shift = (64 - size - (start & 31)).astype(np.uint64)
    two = _codes(lengths)[ids] << shift
    word = start >> 5
    words = np.zeros((total >> 5) + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] += np.add.reduceat(two >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(two & np.uint64(0xFFFFFFFF), first)
    payload = words.astype(">u4").tobytes()[: (total + 7) // 8]
    marks = np.append(start[::block], total).astype("<u8")
    head = np.array([len(lengths), block, len(doc_ids), len(ids)], "<u8").tobytes()
    return b"".join((MAGIC, head, lengths, np.asarray(doc_ids).astype("<i8").tobytes(), np.asarray(sizes).astype("<u8").tobytes(), marks.tobytes(), payload))


def read_header(data: bytes) -> dict:
    """What a file says of itself, and where its codes start."""
    if data[:4] != MAGIC:
        raise ValueError("not a token-id file")
    vocabulary, block, n_docs, n_ids = (int(x) for x in np.frombuffer(data, "<u8", 4, 4))
    at = 36 + vocabulary
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    sizes = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs)
    marks = np.frombuffer(data, "<u8", (n_ids + block - 1) // block + 1, at + 16 * n_docs).astype(np.int64)
    return {"lengths": data[36:at], "block": block, "ids": n_ids, "doc_ids": doc_ids, "sizes": sizes.astype(np.int64), "marks": marks, "codes": at + 16 * n_docs + 8 * len(marks)}


def decode_blocks(data: bytes, first: int = 0, last: int | None = None, head: dict | None = None) -> np.ndarray:
    """The ids (uint32) of blocks first..last-1 of a file. The blocks are decoded side by side, an id of each at a time."""
    head = head or read_header(data)
    marks, block = head["marks"], head["block"]
    last = len(marks) - 1 if last is None else last
    table = _table(head["lengths"])
    raw = np.frombuffer(data, np.uint8, offset=head["codes"])
    raw = np.concatenate((raw, np.zeros(8, np.uint8)))
    # windows[i]: the four bytes from i on; a code of 18 bits at any bit of a byte lies within them.
    wide = raw.astype(np.uint32)
    windows = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    counts = np.minimum(block, head["ids"] - block * np.arange(first, last))
    out = np.zeros((last - first, block), np.uint32)
    bit = marks[first:last].copy()
    full = int(counts.min(initial=block))
    mask = (1 << MOST_BITS) - 1
    for k in range(int(counts.max(initial=0))):
        if k >= full:
            live = np.flatnonzero(counts > k)
            found = table[(windows[bit[live] >> 3].astype(np.int64) >> (32 - MOST_BITS - (bit[live] & 7))) & mask]
            out[live, k], bit[live] = found >> 5, bit[live] + (found & 31)
        else:
            found = table[(windows[bit >> 3].astype(np.int64) >> (32 - MOST_BITS - (bit & 7))) & mask]
            out[:, k] = found >> 5
            bit += found & 31
    if (bit != marks[first + 1 : last + 1]).any():
        raise ValueError("a block doesn't end at the next checkpoint")
    return out.reshape(-1)[: int(counts.sum())] if len(counts) else np.empty(0, np.uint32)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row, n, ids): the ids of every text and its end id, as little-endian uint16 if all fit, else uint32 bytes."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches):
            ids = [np.append(encode(t), np.uint32(end_id)) for t in texts_of(batch)]
            n = np.array([len(i) for i in ids], np.int64)
            packed = [i.astype("<u2" if i.max() < 1 << 16 else "<u4").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])

    return picked.mapInArrow(run, "doc_id long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def _unpack(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of all rows of a batch, in order."""
    n = batch.column("n").to_numpy()
    parts = [np.frombuffer(b, "<u2" if len(b) == 2 * k else "<u4") for b, k in zip(batch.column("ids").to_pylist(), n.tolist(), strict=True)]
    return np.concatenate(parts).astype(np.uint32, copy=False) if parts else np.empty(0, np.uint32)


def id_counts(table: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole table. What is collected is a row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            more = np.bincount(_unpack(batch))
            if len(more) > len(sums):
                sums, more = more.astype(np.int64), sums
            sums[: len(more)] += more
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["id", "n"])

    rows = table.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows.id.max()) + 1 if len(rows) else 0, np.int64)
    counts[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return counts


def write_files(table: DataFrame, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """The files of a table of token ids: rows (file, part, documents, ids, data), files and their parts in ascending id order.

    Code lengths come from the counts of all ids in the table. Documents are dealt out by
    ranges of (doc_id, row), so files follow each other in id order (a null id comes
    first); a range with more than ``file_ids`` ids is written as several parts, each a
    file, so memory is bounded by that and the longest document.
    """
    counts = id_counts(table)
    lengths = code_lengths(counts).tobytes()
    total = int(counts.sum())
    ranges = max(1, -(-total // (4 * file_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            docs = np.concatenate([d for d, _, _ in held])
            ids = np.concatenate([i for _, _, i in held])
            data = encode_file(docs, np.concatenate([n for _, n, _ in held]), ids, lengths, block)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.int32()), (part, pa.int32()), (len(docs), pa.int64()), (len(ids), pa.int64()), (data, pa.binary()))], names)

        for batch in slices(batches, "ids", size=1 << 20):
            held.append((batch.column("doc_id").fill_null(NULL).to_numpy(), batch.column("n").to_numpy(), _unpack(batch)))
            size += len(held[-1][2])
            if size >= file_ids:
                yield done()
                part, held, size = part + 1, [], 0
        if held:
            yield done()

    names = ["file", "part", "documents", "ids", "data"]
    ordered = table.select("doc_id", "n", "ids", "row").repartitionByRange(ranges, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return ordered.mapInArrow(run, "file int, part int, documents long, ids long, data binary")


#: How a file writes a null document id.
NULL = -(1 << 63)


def read_files(files: DataFrame) -> DataFrame:
    """The documents of files, read back: (file, part, doc_id, local_start, n_tokens, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", rows=1):
            data = batch.column("data")[0].as_buffer()
            data = memoryview(data).tobytes()
            head = read_header(data)
            ids = decode_blocks(data, head=head)
            ends = np.cumsum(head["sizes"])
            starts = ends - head["sizes"]
            crcs = [crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crcs)
            docs = pa.array(head["doc_ids"].astype(np.int64), mask=head["doc_ids"] == NULL)
            same = [pa.array([batch.column(c)[0].as_py()] * n, pa.int32()) for c in ("file", "part")]
            yield pa.RecordBatch.from_arrays([*same, docs, pa.array(starts), pa.array(head["sizes"]), pa.array(crcs, pa.int64())], names)

    names = ["file", "part", "doc_id", "local_start", "n_tokens", "ids_crc32"]
    return files.select("file", "part", "data").mapInArrow(run, "file int, part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents as files and read the files back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts are their end id alone. Repeated ids are documents of their own, in
    the order of the table; null ids come first. Other columns are not read. An empty table gives an
    empty one. The files are a table in the shared folder, a row per file.
    """
    table = written(token_ids(docs, tokenizer or public_tokenizers.path(TOKENIZER), end_id, id_col, text_col), "token_ids")
    files = written(write_files(table, block, file_ids), "files")
    before = F.sum("ids").over(W.orderBy("file", "part").rowsBetween(W.unboundedPreceding, -1))
    bases = files.select("file", "part", "ids").select("file", "part", F.coalesce(before, F.lit(0)).alias("base"))  # a row per file
    return read_files(files).join(bases, ["file", "part"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read back from the files that all were written to."""
    return round_trip(documents(spark, sf_dir))


QUERIES = {"op3_huffman_token_files": op3_huffman_token_files}
ORACLES: dict[str, str] = {}
