"""Repeated paragraphs by MinHash banding, verified by exact Jaccard similarity and grouped by components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, documents, slices, texts_of, written
from .components import components

WIDTH = 5
SIMILAR = 0.8
#: 8 bands of 3 rows: of pairs at 0.8 all but 1 in 310 meet in a band, at 0.9 all but 1 in 30,000; equal paragraphs always.
BANDS, ROWS = 8, 3
#: A paragraph begins where the hash of three words is least among this many words on either side.
REACH = 10
#: Neighbouring repeated paragraphs of fewer words together stay: phrases, headings and notices of a line.
LEAST_RUN = 16
#: Members of a band group that one task compares with another such lot.
LOT = 1000

_LAST = np.uint64((1 << 64) - 1)
_R = np.random.RandomState(20240229)
_A = (_R.randint(0, 1 << 62, 256).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _R.randint(0, 1 << 62, 256).astype(np.uint64)
_LETTER = _R.randint(0, 1 << 62, 256).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_BASES = [int(x) for x in _R.randint(0, 1 << 62, 4).astype(np.uint64) << np.uint64(1) | np.uint64(1)]
_IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
#: Bytes of words hashed at a time, and the length from which a word is hashed by itself.
_BLOCK, _LONG = 1 << 18, 1 << 12


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 .. 2**bits of an odd number and of its inverse, modulo 2**64."""
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full((1 << bits) + 1, x, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _runs_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[first:last] for each pair, whatever stands around them."""
    up, down = _powers(base, max(19, int(len(values)).bit_length()))  # mostly one table for each base
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return _mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def _word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    long = end - start > _LONG
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
    at, done = np.flatnonzero(~long), 0
    while done < len(at):
        low = int(start[at[done]])
        upto = int(np.searchsorted(start[at], low + _BLOCK))
        some = at[done:upto]
        letters = _LETTER[np.frombuffer(data, np.uint8, int(end[some[-1]]) - low, low)]
        out[some] = _runs_hash(letters, start[some] - low, end[some] - low, _BASES[0])
        done = upto
    return out


class Words:
    """The words of some texts: A-Z lowered, cut at the six blanks. text, start and end (bytes in ``data``) and hash of each."""

    def __init__(self, texts: list[str]):
        raw = [x.encode() for x in texts]
        self.data = b"\n".join([*raw, b""]).lower()
        self.text_start = np.cumsum([0, *[len(x) + 1 for x in raw]])
        letters = ~_IS_BLANK[np.frombuffer(self.data, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letters, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.hash = _word_hashes(self.data, self.start, self.end)
        self.new = np.concatenate(([True], self.text[1:] != self.text[:-1])) if len(self.text) else np.empty(0, bool)

    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends in its text, in code points."""
        before = np.concatenate(([0], np.cumsum((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)))
        base = before[self.text_start[self.text]]
        return before[self.start] - base, before[self.end] - base


#: The first word of each part of the texts that is compared; the parts lie end to end.
Split = Callable[[Words], np.ndarray]


def whole(words: Words) -> np.ndarray:
    """Every text with a word is one part."""
    return np.flatnonzero(words.new)


def paragraphs_of(words: Words, reach: int = REACH) -> np.ndarray:
    """Content-defined paragraphs, about 2 * reach + 1 words each, without regard to line ends.

    A paragraph begins with a text and where the hash of a word and the two after it is
    less than those of the ``reach`` words before and no more than those of the ``reach``
    after. So a passage that is repeated is cut alike wherever it stands and however it is wrapped,
    but for its first and last words.
    """
    n = len(words.hash)
    if not n:
        return np.empty(0, np.int64)
    grams = np.full(n, _LAST)
    if n > 2:
        low, mid = np.uint64(_BASES[1]), np.uint64(pow(_BASES[1], 2, 1 << 64))
        inside = words.text[2:] == words.text[:-2]
        grams[:-2][inside] = _mixed(words.hash[:-2] + words.hash[1:-1] * low + words.hash[2:] * mid)[inside]
    place = np.arange(n) + (words.text + 1) * reach  # so that no text reaches into another
    padded = np.full(int(place[-1]) + reach + 1, _LAST)
    padded[place] = grams
    left, right = np.full(n, _LAST), np.full(n, _LAST)
    for d in range(1, reach + 1):
        np.minimum(left, padded[place - d], out=left)
        np.minimum(right, padded[place + d], out=right)
    return np.flatnonzero(words.new | ((grams < left) & (grams <= right)))


@dataclass
class Parts:
    """The parts of some texts: text, number in it, first and last word, hash of the words (equal parts are one)."""

    words: Words
    text: np.ndarray
    number: np.ndarray
    first: np.ndarray
    last: np.ndarray
    p: np.ndarray


def parts_of(texts: list[str], split: Split) -> Parts:
    words = Words(texts)
    first = split(words)
    last = np.append(first[1:], len(words.hash)) if len(first) else first
    text = words.text[first]
    opens = np.searchsorted(text, text)  # the first part of the same text
    return Parts(words, text, np.arange(len(first)) - opens, first, last, _runs_hash(words.hash, first, last, _BASES[2]).view(np.int64))


def shingles(parts: Parts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shingle that starts at each word, and whether one does; fewer words than ``width`` are one shingle."""
    n = len(parts.words.hash)
    at = np.arange(n)
    size = parts.last - parts.first
    there = at + width <= np.repeat(parts.last, size)
    hashes = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        hashes[: n - k] += parts.words.hash[k:] * np.uint64(pow(_BASES[3], k, 1 << 64))
    hashes = _mixed(hashes)
    short = size < width
    hashes[parts.first[short]] = parts.p[short].view(np.uint64)
    there[parts.first[short]] = True
    return hashes, there


def band_keys(hashes: np.ndarray, there: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each part and band: the band's number and the least values of its hash functions over the part's shingles."""
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(first), axis=0)
    for k in range(bands * rows):
        value = hashes * _A[k] + _B[k]
        value ^= value >> np.uint64(32)
        value[~there] = _LAST
        column = keys[:, k // rows]
        column[:] = (column ^ np.minimum.reduceat(value, first)) * np.uint64(0x9E3779B97F4A7C15)
        column ^= column >> np.uint64(29)
    return keys


def _find(split: Split):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=4 << 20):
            parts = parts_of(texts_of(batch), split)
            start, end = parts.words.code_points()
            rows = pa.array(parts.text)
            columns = [batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array(parts.number, pa.int32()), pa.array(start[parts.first]), pa.array(end[parts.last - 1]), pa.array(parts.last - parts.first), pa.array(parts.p)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "para", "start", "end", "n_words", "p"])

    return run


def _band_rows(buckets: int, split: Split, bands: int, rows: int):
    """Over texts: (bucket, keys and parts packed), each part once for the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=4 << 20):
            parts = parts_of(texts_of(batch), split)
            if not len(parts.p):
                continue
            each = band_keys(*shingles(parts), parts.first, bands, rows)
            some, at = np.unique(parts.p, return_index=True)
            keys, ps = each[at].ravel(), np.repeat(some, bands)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
            out = [(int(bucket[order[a]]), keys[order[a:b]].tobytes() + ps[order[a:b]].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "data"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the rows of a bucket: (key, p) for keys that more than one paragraph has."""

    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in blobs]).view(np.int64)
        p = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs])
        order = np.lexsort((p, key))
        key, p = key[order], p[order]
        one = np.concatenate(([True], (key[1:] != key[:-1]) | (p[1:] != p[:-1])))
        key, p = key[one], p[one]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        many = np.diff(np.append(np.flatnonzero(new), len(key)))[np.cumsum(new) - 1] > 1
        return pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(p[many])], ["key", "p"])

    now, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if bucket != now and held:
                yield settle(held)
                held = []
            now = bucket
            held.append(data)
    if held:
        yield settle(held)


def similar_pairs(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of at least ``least`` that join two components, until no pair would."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    label = np.arange(len(sets))
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    for i in range(len(sets)):
        if (label == label[i]).all():
            continue
        mine = flat[starts[i] : ends[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[mine] = 0
        near = np.flatnonzero((both >= least * (sizes + sizes[i] - both)) & (label != label[i]))
        for j in near.tolist():
            if label[j] != label[i]:
                yield i, j
                label[label == max(label[i], label[j])] = min(label[i], label[j])


def _verify(similar: float):
    """Over (lot, p, set) rows sorted by lot: edges between paragraphs, enough for the components of each lot."""

    def edges(ps: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        return [(ps[i], ps[j]) for i, j in similar_pairs([np.frombuffer(s, np.uint64) for s in sets], similar)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ps, sets = None, [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for lot, p, data in zip(*(batch.column(n).to_pylist() for n in ("lot", "p", "data")), strict=True):
                if lot != now and ps:
                    out += edges(ps, sets)
                    ps, sets = [], []
                now = lot
                if not ps or ps[-1] != p:
                    ps.append(p)
                    sets.append(data)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        if ps:
            out = edges(ps, sets)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return run


def _sets(split: Split):
    """Over texts and the numbers of some of their parts: the shingle set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=4 << 20):
            parts = parts_of(texts_of(batch), split)
            hashes, there = shingles(parts)
            wanted = batch.column("wanted")
            of = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            asked = np.isin(parts.text * (1 << 32) + parts.number, of * (1 << 32) + wanted.flatten().to_numpy())
            ps, data = [], []
            for p, a, b in zip(parts.p[asked].tolist(), parts.first[asked].tolist(), parts.last[asked].tolist(), strict=True):
                ps.append(p)
                data.append(np.unique(hashes[a:b][there[a:b]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(data, pa.binary())], ["p", "data"])

    return run


def banded(picked: DataFrame, split: Split, bands: int = BANDS, rows: int = ROWS, bucket_bytes: int = 48 << 20) -> DataFrame:
    """Rows (key, p): the parts of the texts that share a MinHash band with another part."""
    spark = picked.sparkSession
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes))
    sent = picked.select("text").mapInArrow(_band_rows(buckets, split, bands, rows), "bucket int, data binary")
    return written(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_groups, "key long, p long"), "members")


def linked(picked: DataFrame, firsts: DataFrame, members: DataFrame, split: Split, similar: float, lot: int) -> DataFrame:
    """Labels (p, label) of the parts that are similar to another member of a group.

    picked: (doc_id, tag, text); firsts: one row a part (p, first, tag), first being (doc, para)
    of a text that has it; members: (key, p) rows of a written table.
    """
    last = F.lit((1 << 63) - 1)
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("p").cast("decimal(20,0)")).alias("sum"), F.sum(F.xxhash64("p", F.lit(1)).cast("decimal(20,0)")).alias("sum2"))
    once = groups.groupBy("n", "sum", "sum2").agg(F.min("key").alias("key")).select("key", "n")
    chosen = written(members.join(once, "key"), "chosen")

    wanted = firsts.join(chosen.select("p").distinct(), "p", "left_semi").groupBy(F.col("first.doc").alias("doc"), "tag").agg(F.collect_set("first.para").alias("wanted"))
    texts = picked.withColumn("doc", F.coalesce("doc_id", last)).join(wanted, ["doc", "tag"]).select("text", "wanted")
    sets = written(texts.mapInArrow(_sets(split), "p long, data binary").dropDuplicates(["p"]), "sets")

    lots = F.ceil(F.col("n") / lot).cast("int")
    mine = F.pmod(F.xxhash64("p", F.lit(2)), lots.cast("long")).cast("int")
    dealt = chosen.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), lots - 1)))
    dealt = dealt.select("p", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("lot"))
    ready = dealt.join(sets, "p").repartition("lot").sortWithinPartitions("lot", "p")
    edges = ready.select("lot", "p", "data").mapInArrow(_verify(similar), "a long, b long")
    return components(edges).select(F.col("node").alias("p"), "label")


def repeated_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, reach: int = REACH, least_run: int = LEAST_RUN, bands: int = BANDS, rows: int = ROWS, lot: int = LOT, bucket_bytes: int = 48 << 20
) -> DataFrame:
    """The paragraphs to remove: (doc_id, para, start, end, n_words, kept_doc_id, kept_para).

    Paragraphs are cut by content (paragraphs_of) and every word is in one; para counts
    them from 0, start and end are code points. Two paragraphs link if they are equal (A-Z
    lowered, blanks aside) or meet in a MinHash band and their sets of five-word shingles
    have a Jaccard similarity of ``similar`` or more. Of each component the first paragraph
    by (doc_id, para) stays and the others are repeats; it is named beside them. Repeats
    that are neighbours in a text are one run, and runs of fewer than ``least_run`` words
    are left alone; with 1 every repeat goes.

    Null and empty texts have no paragraphs; a null id comes last. Repeated rows are one
    document: their paragraphs are listed once. Different texts of the same id are parts of
    one document, where paragraphs of the same number are not repeats of each other. Other
    columns are not read; an empty table gives an empty one.

    Equal paragraphs are one node. A batch of texts sends each of its paragraphs to its
    bands once, so a common one costs a row a batch. Groups of the same members in several
    bands are compared once; groups over ``lot`` members are cut into lots and every two
    lots meet in a task, so no group comes into one task and no pair is left out.
    """
    split = partial(paragraphs_of, reach=reach)
    last = F.lit((1 << 63) - 1)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = written(picked.mapInArrow(_find(split), "doc_id long, tag long, para int, start long, end long, n_words long, p long"), "paragraphs")
    place = F.struct(F.coalesce("doc_id", last).alias("doc"), F.col("para"))
    firsts = written(found.groupBy("p").agg(F.min(place).alias("first"), F.min_by("tag", place).alias("tag"), F.count("*").alias("times")), "firsts")
    labels = linked(picked, firsts, banded(picked, split, bands, rows, bucket_bytes), split, similar, lot)

    named = firsts.join(labels, "p", "left").select("p", "first", "times", F.col("label")).where("times > 1 or label is not null")
    keepers = named.where("label is not null").groupBy("label").agg(F.min("first").alias("keeper"))
    fate = written(named.join(keepers, "label", "left").select("p", F.coalesce("keeper", "first").alias("keeper")), "fate")
    doomed = found.join(fate, "p").where(place != F.col("keeper")).repartition("doc_id", "tag").dropDuplicates(["doc_id", "tag", "para"])
    here = W.partitionBy("doc_id", "tag")
    doomed = doomed.withColumn("run", F.col("para") - F.row_number().over(here.orderBy("para"))).withColumn("run_words", F.sum("n_words").over(W.partitionBy("doc_id", "tag", "run")))
    kept_id = F.when(F.col("keeper.doc") != last, F.col("keeper.doc"))
    return doomed.where(F.col("run_words") >= least_run).select("doc_id", "para", "start", "end", "n_words", kept_id.alias("kept_doc_id"), F.col("keeper.para").alias("kept_para"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of the documents that repeats an earlier one, in runs of 16 words or more, and which it repeats."""
    return repeated_paragraphs(documents(spark, sf_dir))


QUERIES = {"op6_paragraph_dedup": op6_paragraph_dedup}
ORACLES: dict[str, str] = {}
