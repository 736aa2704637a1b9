"""Near-duplicate documents by SimHash, linked with a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts_of, written
from .components import components

BITS = 64
SEED = 42


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the word shingles of a text: a bit is 1 if set in over half their XXH64 values.

    A-Z are lowered, words are split at the six ASCII blanks. A text of fewer words than
    ``width`` is one shingle; a text without words has fingerprint 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = xxhash.xxh64_digest(line, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fp long): the signed form of each text's fingerprint. Null texts count as empty; rows stay one to one."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(x, width) for x in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp)], ["id", "fp"])

    return picked.mapInArrow(run, "id long, fp long")


def trie_pairs(group: np.ndarray, value: np.ndarray, budget: int, counts: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group whose 64-bit values differ in at most ``budget`` bits.

    ``group`` and ``value`` (uint64) are sorted together, without repeats. Every group is
    the root of a binary trie over its sorted values, a node being a range of rows. Pairs
    of nodes go down together, starting from (root, root): a pair of unlike children adds
    a differing bit, and a pair over the budget is dropped. Only pairs of single values are
    compared by the bits that are left. Frontiers are worked off in slices, so memory stays
    bounded whatever the number of pairs. counts, if given, gains the pairs of nodes
    ``split`` and the pairs of their children that were ``pruned``.
    """
    n = len(value)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], n)
    keep = ends - starts > 1
    root = np.stack([starts[keep], ends[keep], starts[keep], ends[keep], np.zeros(keep.sum(), np.int64)]).astype(np.int64)
    stack = [(BITS - 1, root)]
    while stack:
        bit, nodes = stack.pop()
        if nodes.shape[1] > 1 << 18:
            half = nodes.shape[1] // 2
            stack += [(bit, nodes[:, :half]), (bit, nodes[:, half:])]
            continue
        small = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) == 1
        if bit < 0:
            small[:] = True
        if small.any():
            yield from _compare(nodes[:, small], value, budget)
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        ones = np.concatenate(([0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        alo, ahi, blo, bhi, diff = nodes
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        unlike = diff + 1
        same = alo == blo
        down = np.concatenate(
            [np.stack([alo, amid, blo, bmid, diff]), np.stack([amid, ahi, bmid, bhi, diff]), np.stack([alo, amid, bmid, bhi, unlike]), np.stack([amid, ahi, blo, bmid, unlike])[:, ~same]],
            axis=1,
        )
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & ~((down[0] == down[2]) & (down[1] - down[0] < 2))]
        within = down[4] <= budget
        if counts is not None:
            counts["split"] = counts.get("split", 0) + nodes.shape[1]
            counts["pruned"] = counts.get("pruned", 0) + int((~within).sum())
        down = down[:, within]
        if down.shape[1]:
            stack.append((bit - 1, down))


def _compare(nodes: np.ndarray, value: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    alo, ahi, blo, bhi, _ = nodes
    width = bhi - blo
    counts = (ahi - alo) * width
    for k in range(0, len(counts), 1 << 15):
        c, w = counts[k : k + (1 << 15)], width[k : k + (1 << 15)]
        at = np.repeat(np.arange(k, k + len(c)), c)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c)
        i, j = alo[at] + inner // np.repeat(w, c), blo[at] + inner % np.repeat(w, c)
        near = (np.bitwise_count(value[i] ^ value[j]) <= budget) & (i < j)
        if near.any():
            yield i[near], j[near]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The root of each of n nodes (the least node of its component) after all pairs are joined."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _join_partition(budget: int, rows: int):
    """Over rows sorted by (key, fp): the links of each key as edges to the least fingerprint of each local component."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        value = fp.view(np.uint64) ^ np.uint64(1 << 63)  # the order of signed values
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
        key, fp, value = key[first], fp[first], value[first]
        root = _forest(len(fp), trie_pairs(key, value, budget))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy()))
            if len(keys) >= rows:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield links(keys[:cut], fps[:cut])
                    keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield links(keys, fps)

    return run


def _blocks(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """The bits first..last-1 in n runs of (shift, width)."""
    cuts = [first + (last - first) * k // n for k in range(n + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(n)]


def links(fps: DataFrame, budget: int = 2, node_rows: int = 2000) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within ``budget`` bits.

    fps: a column fp of distinct longs. Two values within the budget agree in one of
    budget + 1 runs of bits, so each value goes to the tries of its budget + 1 runs; a trie
    has the values that share a run. A trie with more than ``node_rows`` values is dealt out
    again by runs of the bits that are still free, which loses no pair for the same reason, and so
    on for three levels; values being distinct, what is left is small. Tries of one value go.
    """
    parts = budget + 1
    level = fps.select("fp", F.explode(_runs(_blocks(0, BITS, parts))).alias("run"), F.lit(0).cast("long").alias("above"), F.lit("").alias("used"))
    done = None
    for depth in range(3):
        mask = F.expr("shiftleft(1L, run.w) - 1L")
        keyed = level.select(
            "fp",
            F.xxhash64("above", "used", F.col("run.s"), F.expr("shiftrightunsigned(fp, run.s)").bitwiseAND(mask)).alias("key"),
            F.concat_ws(",", F.when(F.col("used") != "", F.col("used")), F.concat_ws(":", F.col("run.s"), F.col("run.w"))).alias("used"),
        )
        if depth:
            keyed = written(keyed, "level")
        sized = keyed.join(keyed.groupBy("key").count().where("count > 1"), "key")
        if depth == 2:
            part, more = sized.select("key", "fp"), None
        else:
            sized = written(sized, "tries")
            part, more = sized.where(F.col("count") <= node_rows).select("key", "fp"), sized.where(F.col("count") > node_rows)
        done = part if done is None else done.union(part)
        if more is None or more.isEmpty():
            break
        level = more.select("fp", F.explode(_free_runs(F.col("used"), parts)).alias("run"), F.col("key").alias("above"), "used")
    return done.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_join_partition(budget, 1 << 17), "a long, b long")


def _free_runs(used: F.Column, parts: int) -> F.Column:
    """The free bits of a trie in ``parts`` runs each of which lies in one gap between the used ones.

    ``used`` is one of few strings "shift:width,...", so the runs of each are worked out once, here.
    """
    whole = _blocks(0, BITS, parts)
    found = None
    for s, w in whole:
        first = f"{s}:{w}"
        gaps = [x for x in whole if x != (s, w)]
        runs = _split(gaps, parts)
        found = _case(found, used == first, runs)
        for t, v in runs:
            found = _case(found, used == f"{first},{t}:{v}", _split(_minus(gaps, (t, v)), parts))
    return found


def _runs(runs: list[tuple[int, int]]) -> F.Column:
    return F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in runs])


def _case(found, when: F.Column, runs: list[tuple[int, int]]):
    value = _runs(runs)
    return F.when(when, value) if found is None else found.when(when, value)


def _split(gaps: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """At least ``parts`` runs that cover the gaps: the widest is halved until there are enough."""
    runs = [g for g in gaps if g[1]]
    while len(runs) < parts:
        s, w = max(runs, key=lambda g: g[1])
        runs.remove((s, w))
        runs += [(s, w // 2), (s + w // 2, w - w // 2)]
    return sorted(runs)


def _minus(gaps: list[tuple[int, int]], run: tuple[int, int]) -> list[tuple[int, int]]:
    out = []
    for s, w in gaps:
        lo, hi = max(s, run[0]), min(s + w, run[0] + run[1])
        if lo >= hi:
            out.append((s, w))
        else:
            out += [x for x in ((s, lo - s), (hi, s + w - hi)) if x[1]]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """One row per document: (doc_id, fingerprint hex string, component_id).

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the smallest
    doc_id reachable over links, the document's own included. Texts that are null, empty or
    blank have fingerprint zero and link like any other. Equal fingerprints are one node of
    the graph, so copies cost nothing. A null doc_id keeps its row and is never a smallest
    id; repeated ids and rows are kept. Other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    labels = components(links(nodes.select("fp"), budget)).select(F.col("node").alias("fp"), "label")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = written(named.select("fp", "label").join(least, "label").select("fp", "component_id"), "of")
    return fps.join(of, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links at two bits."""
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLES: dict[str, str] = {}
