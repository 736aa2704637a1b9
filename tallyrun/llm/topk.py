"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SCALE = 256
K = 5
QUERY_EVERY = 50
#: Vectors of a superblock (what one task scores at a time), of a pruning block in it, and queries of a pack.
SUPERBLOCK, BLOCK, PACK = 8192, 128, 2048
#: Superblocks whose bounds one task compares with a pack of queries.
CHUNK = 1024


def integers(vectors: list) -> np.ndarray:
    """floor(SCALE * x) of each component as float64, which holds it exactly up to 2**53."""
    return np.floor(SCALE * np.array(vectors, np.float64).reshape(len(vectors), -1 if vectors else 0))


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products. In float64 where every partial sum is exact there, else in Python integers held to the range of a long."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] < 2.0**53:
        return (q @ d.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    wide = exact(q) @ exact(d).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each of n queries: higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.score, self.id, self.floor = k, np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), floor.copy()
        self.size = np.zeros(n, np.int64)

    def kth(self) -> np.ndarray:
        """What a score must reach to matter: the kth best so far, or what was known before."""
        full = self.size == self.k
        return np.where(full, np.maximum(self.score[:, -1], self.floor), self.floor)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries ``at`` (rows) with the vectors ``ids`` (columns); a query's own vector (own) is none of its candidates."""
        q, d = np.nonzero((scores >= self.kth()[at][:, None]) & (ids[None, :] != own[:, None]))
        if not len(q):
            return
        held, slot = np.nonzero(np.arange(self.k)[None, :] < self.size[at][:, None])
        who = np.concatenate([q, held])
        score = np.concatenate([scores[q, d], self.score[at[held], slot]])
        vec = np.concatenate([ids[d], self.id[at[held], slot]])
        order = np.lexsort((vec, -score.astype(object)) if score.min() == -(1 << 63) else (vec, -score))
        order = order[np.argsort(who[order], kind="stable")]
        who, score, vec = who[order], score[order], vec[order]
        start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        place = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        keep = place < self.k
        self.score[at[who[keep]], place[keep]], self.id[at[who[keep]], place[keep]] = score[keep], vec[keep]
        self.size[at[np.unique(who)]] = np.minimum(np.bincount(who)[np.unique(who)], self.k)


def search(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, d: np.ndarray, did: np.ndarray, k: int, block: int = BLOCK) -> Best:
    """The k best of a superblock for every query, scoring blocks in order of their bounds.

    The components are the terms. A block is a range of vectors by id; it keeps the largest
    and least weight of each term, and its bound for a query is the sum over terms of the
    query's weight times the largest (of a negative weight: the least). Each query takes
    the blocks from the highest bound down, scores their vectors through the block's
    forward index, and stops when the next bound is below its kth score (equal bounds may
    still hold a smaller id, so they are scored).
    """
    best = Best(len(q), k, floor)
    if not len(q) or not len(d):
        return best
    cuts = list(range(0, len(d), block))
    high, low = np.maximum.reduceat(d, cuts), np.minimum.reduceat(d, cuts)
    bound = block_bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(q))
    for turn in range(len(cuts)):
        nxt = order[live, turn]
        go = bound[live, nxt] >= best.kth()[live]
        live, nxt = live[go], nxt[go]
        if not len(live):
            break
        for b in np.unique(nxt):
            at = live[nxt == b]
            rows = slice(cuts[b], cuts[b] + block)
            best.add(at, products(q[at], d[rows]), did[rows], qid[at])
    return best


def block_bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block no less than any score: the sum over terms of the weight times the block's largest (of a negative weight: least)."""
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return bound if float(np.abs(bound).max(initial=0)) < 2.0**52 else np.full_like(bound, math.inf)  # rounded bounds prune nothing


def _extremes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over vectors: largest and least weight of each term, for each superblock, length and batch."""
    for pdf in parts:
        rows = []
        for (sb, dim), mine in pdf.groupby(["sb", "dim"]):
            x = integers(mine.v.tolist())
            rows.append((sb, dim, x.max(axis=0, initial=-math.inf).tolist(), x.min(axis=0, initial=math.inf).tolist()))
        yield pd.DataFrame(rows, columns=["sb", "dim", "high", "low"])


def met(queries: DataFrame, extremes: DataFrame, parts: int, n_queries: int, best: bool, pack: int = PACK, chunk: int = CHUNK) -> DataFrame:
    """Rows (row, sb, bound): of each query the superblock of the highest bound (best), or all whose bound reaches its floor.

    Packs of queries meet chunks of bounds, a row for each superblock and not for each vector;
    only the pairs that are found go on.
    """
    packs, chunks = max(1, math.ceil(n_queries / pack)), math.ceil(parts / chunk)
    asked = queries.select("row", "v", "dim", "floor", F.pmod(F.xxhash64("row"), F.lit(packs)).cast("int").alias("pack"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    held = extremes.select("*", F.floor(F.col("sb") / chunk).cast("int").alias("in_chunk"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("for_pack"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"row": np.empty(0, np.int64), "sb": np.empty(0, np.int32), "bound": np.empty(0)})]
        for dim, mine in left.groupby("dim"):
            blocks = right[right.dim == dim].sort_values("sb")
            if not len(blocks):
                continue
            sb = blocks.sb.to_numpy()
            first = np.flatnonzero(np.concatenate(([True], sb[1:] != sb[:-1])))
            bound = block_bounds(integers(mine.v.tolist()), *(np.array(blocks[x].tolist()).reshape(len(blocks), -1) for x in ("high", "low")))
            bound = np.maximum.reduceat(bound, first, axis=1)
            q, at = (np.arange(len(mine)), bound.argmax(axis=1)) if best else np.nonzero(bound >= mine.floor.to_numpy()[:, None])
            out.append(pd.DataFrame({"row": mine.row.to_numpy()[q], "sb": sb[first][at], "bound": bound[q, at]}))
        return pd.concat(out[1:] or out)

    pairs = asked.groupBy("pack", "chunk").cogroup(held.groupBy("for_pack", "in_chunk")).applyInPandas(meet, "row long, sb int, bound double")
    return pairs.groupBy("row").agg(F.max_by("sb", "bound").alias("sb"), F.max("bound").alias("bound")) if best else pairs


def scored(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int, pack: int = PACK) -> DataFrame:
    """Rows (row, query_id, vec_id, score): the k best of each superblock that a query is paired with.

    The queries of a superblock are cut into packs and each pack has a copy of the
    superblock, so a task holds one of each however many queries ask for it.
    """
    sized = written(pairs.groupBy("sb").agg(F.ceil(F.count("*") / pack).cast("int").alias("packs")), "sized")
    asked = pairs.select("row", "sb").join(sized, "sb").join(queries.select("row", "id", "v", "dim", "floor"), "row")
    asked = asked.withColumn("pack", F.pmod(F.xxhash64("row"), F.col("packs").cast("long")).cast("int")).drop("packs")
    held = blocks.select("sb", "id", "v", "dim").join(sized, "sb").select(F.col("sb").alias("of"), "id", "v", "dim", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("for_pack"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})]
        right = right.sort_values("id", kind="stable")
        for dim, mine in left.groupby("dim"):
            others = right[right.dim == dim]
            found = search(integers(mine.v.tolist()), mine.id.to_numpy(), mine.floor.to_numpy(), integers(others.v.tolist()), others.id.to_numpy(), k)
            q, place = np.nonzero(np.arange(k)[None, :] < found.size[:, None])
            out.append(pd.DataFrame({"row": mine.row.to_numpy()[q], "query_id": mine.id.to_numpy()[q], "vec_id": found.id[q, place], "score": found.score[q, place]}))
        return pd.concat(out[1:] or out)

    return asked.groupBy("sb", "pack").cogroup(held.groupBy("of", "for_pack")).applyInPandas(meet, "row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, superblock: int = SUPERBLOCK, pack: int = PACK) -> DataFrame:
    """Exact k best partners of every query: (query_id, rank, vec_id, score).

    is_query: a condition on the id column. Components count as floor(256 * x); the score
    is the integer inner product, ties go to the smaller id, a row is not its own partner,
    and a query with fewer partners gets all. Vectors that are null or hold null, NaN or
    infinite components, and rows with a null id, take no part. Vectors of different
    lengths are scored within their length only. Repeated ids are distinct rows, except
    that a query never meets rows with its own id. Products past the range of a long are
    held to it. Other columns are not read. An empty table gives an empty one.

    Vectors are cut into superblocks by ranges of ids. The bounds of superblocks, a row for
    each, meet the queries first: every query is scored in the superblock of its highest
    bound, which gives a kth score to start from, and then only in those whose bound
    reaches that score. Vectors move for these pairs alone.
    """
    sound = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(sound)
    rows = written(rows.select("id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    parts = max(1, math.ceil(rows.count() / superblock))
    ranged = rows.repartitionByRange(parts, "dim", "id", "row").withColumn("sb", F.spark_partition_id())
    blocks = written(ranged.withColumn("is_query", F.coalesce(is_query(F.col("id")), F.lit(False))), "superblocks")
    extremes = written(blocks.select("sb", "dim", "v").mapInPandas(_extremes, "sb int, dim int, high array<double>, low array<double>"), "extremes")

    none = F.lit(-(1 << 63)).cast("long")
    queries = written(blocks.where("is_query").select("row", "id", "v", "dim", none.alias("floor")), "asked")
    n_queries = queries.count()
    seeds = written(met(queries, extremes, parts, n_queries, True, pack), "seeds")
    first = written(scored(seeds, queries, blocks, k, pack), "first")
    kth = first.groupBy("row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best")).where(F.size("best") >= k).select("row", F.element_at("best", k).alias("kth"))
    risen = written(queries.join(kth, "row", "left").withColumn("floor", F.coalesce("kth", "floor")).drop("kth"), "queries")
    pairs = written(met(risen, extremes, parts, n_queries, False, pack).join(seeds.select("row", "sb"), ["row", "sb"], "left_anti"), "pairs")
    found = first.union(scored(pairs, risen, blocks, k, pack))
    order = W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50, among all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % QUERY_EVERY == 0)


QUERIES = {"op9_topk_search": op9_topk_search}

ORACLES = {
    "op9_topk_search": f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
}
