"""Near duplicates among vectors: tiles in the order of their principal components, compared leading components first."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, mixed_id, ranked, written
from .components import components

THRESHOLD = 0.9
#: Vectors of a tile; bytes of the vectors of a strip at most, and strips of smaller tables at most.
TILE, STRIP_BYTES, STRIPS, STRIP_ROWS = 1024, 32 << 20, 8, 2048
#: Leading components that are added up before each look at what the others can still give.
STEPS = (16, 32, 64, 128, 256, 512, 1024, 2048)
#: Products of rotated vectors are this near the true ones; what is nearer to the threshold is computed again from the vectors as given.
MARGIN = 1e-9
#: Vectors that are longer are compared in the order of their own components.
LONGEST_PCA = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(_matrix(batch.column("v"), dim))
            total += (x * batch.column("m").to_numpy()[:, None]).T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    rows = np.array(table.column("row").to_pylist())
    return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "row": pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))})


def principal(classes: DataFrame, dim: int) -> np.ndarray:
    """The axes of the unit vectors as columns, the one with the largest second moment first; the moments are over all rows.

    Each task adds up a matrix of dim * dim numbers, a row of it is summed by a task, and the
    sum comes to the driver: its size goes by the vectors' length, not by how many there are.
    """
    parts = classes.where(F.size("v") == dim).select("v", "m").mapInArrow(_moments(dim), "i int, row array<double>")
    total = np.zeros((dim, dim))
    for r in parts.groupBy("i").applyInArrow(_summed, "i int, row array<double>").collect():
        total[r.i] = r.row
    values, axes = np.linalg.eigh((total + total.T) / 2)
    return np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])


def _leading(axes: dict[int, np.ndarray]):
    """Adds the first coordinate of the rotated unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.zeros(batch.num_rows)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = unit(_matrix(batch.column("v").take(pa.array(at)), dim))
                y[at] = x @ axes[dim][:, 0] if dim in axes else x[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y)], [*batch.schema.names, "lead"])

    return run


def compact_tiles(y: np.ndarray, tile: int) -> list[np.ndarray]:
    """Rows in tiles of at most ``tile`` that lie close together: along its widest component a set is cut where its values leave the widest gap, an eighth of it from either end at least."""
    todo, done = [np.arange(len(y))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= tile:
            done.append(rows)
            continue
        values = y[rows, np.argmax(np.ptp(y[rows], axis=0))]
        order = np.argsort(values, kind="stable")
        edge = max(1, len(rows) // 8)
        cut = edge + int(np.argmax(np.diff(values[order])[edge - 1 : len(rows) - edge]))
        todo += [rows[order[cut:]], rows[order[:cut]]]
    return done


class Side:
    """A strip's vectors, rotated and in tiles."""

    def __init__(self, nodes: np.ndarray, m: np.ndarray, x: np.ndarray, axes: np.ndarray | None, tile: int):
        y = unit(x)
        y = y @ axes if axes is not None else y
        tiles = compact_tiles(y, tile)
        order = np.concatenate(tiles)
        self.nodes, self.m, self.x, self.y = nodes[order], m[order], x[order], y[order]
        dim = y.shape[1]
        self.cuts = [*[s for s in STEPS if s < dim], dim]
        squares = self.y * self.y
        #: Lengths of what is left of each vector after each step.
        self.left = [np.sqrt(squares[:, c:].sum(axis=1)) for c in self.cuts]
        starts = np.cumsum([0, *map(len, tiles)])
        self.tiles = [slice(int(s), int(e)) for s, e in zip(starts, starts[1:])]
        self.low, self.high = (f.reduceat(self.y, starts[:-1]) for f in (np.minimum, np.maximum))


def links_of(a: Side, ta: slice, b: Side, tb: slice, threshold: float, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a's tile, of b's) whose cosine reaches the threshold; within a tile each pair once.

    The product over the first components and the lengths of what is left bound the cosine
    (Cauchy-Schwarz). Pairs that can't reach the threshold are let go, the others get the
    next components.
    """
    ya, yb, cuts = a.y[ta], b.y[tb], a.cuts
    bound = np.c_[ya[:, : cuts[0]], a.left[0][ta]] @ np.c_[yb[:, : cuts[0]], b.left[0][tb]].T
    i, j = np.nonzero(np.triu(bound, 1) >= threshold - MARGIN if inner else bound >= threshold - MARGIN)
    sums = bound[i, j] - a.left[0][ta][i] * b.left[0][tb][j]
    for k in range(1, len(cuts)):
        part = slice(cuts[k - 1], cuts[k])
        for s in range(0, len(i), 1 << 16):
            w = slice(s, s + (1 << 16))
            sums[w] += np.einsum("nd,nd->n", ya[i[w], part], yb[j[w], part])
        alive = sums + a.left[k][ta][i] * b.left[k][tb][j] >= threshold - MARGIN
        i, j, sums = i[alive], j[alive], sums[alive]
    near = np.flatnonzero(np.abs(sums - threshold) <= MARGIN)
    if len(near):
        sums[near] = cosines(a.x[ta][i[near]], b.x[tb][j[near]])
    hit = sums >= threshold
    return i[hit] + ta.start, j[hit] + tb.start


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        plain = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    bad = ~np.isfinite(plain)
    if bad.any():
        plain[bad] = (unit(x[bad]) * unit(y[bad])).sum(axis=1)
    return plain


def _hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after rows i and j are joined: every row has the least row of its component."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j = i[differ], j[differ]
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(label, label[label]):
            label = label[label]


def _compare(threshold: float, axes: dict[int, np.ndarray], tile: int) -> Callable[[pa.Table], pa.Table]:
    reach = 2 - 2 * threshold + MARGIN  # squared distance of unit vectors at the threshold

    def run(table: pa.Table) -> pa.Table:
        first, second, dim = (table.column(c)[0].as_py() for c in ("a", "b", "dim"))
        strips = table.column("strip").to_numpy()
        sides = []
        for strip in dict.fromkeys((first, second)):
            rows = table.take(pa.array(np.flatnonzero(strips == strip))).combine_chunks()
            v = _matrix(rows.column("v").combine_chunks(), dim)
            sides.append(Side(rows.column("node").to_numpy(), rows.column("m").to_numpy(), v, axes.get(dim), tile))
        a, b = sides[0], sides[-1]
        within = a is b
        shift = 0 if within else len(a.nodes)
        nodes = a.nodes if within else np.concatenate([a.nodes, b.nodes])
        links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for p, ta in enumerate(a.tiles):
            gaps = np.maximum(0, np.maximum(a.low[p] - b.high, b.low - a.high[p]))
            for q in np.flatnonzero((gaps * gaps).sum(axis=1) <= reach).tolist():
                if within and q < p:
                    continue
                i, j = links_of(a, ta, b, b.tiles[q], threshold, within and p == q)
                if len(i):
                    np.add.at(links, i, b.m[j])
                    np.add.at(links, j + shift, a.m[i])
                    label = _hooked(label, i, j + shift)
        found = np.flatnonzero(links)
        return pa.table({"node": nodes[found], "links": links[found], "peer": nodes[label[found]]})

    return run


def strips_of(classes: DataFrame, threshold: float, axes: dict[int, np.ndarray], strip_bytes: int, strip_rows: int) -> DataFrame:
    """Vectors (dim, node, m, v, strip, to): each once for every strip ``to`` that may hold a neighbour, its own included.

    Vectors of a length are put in order of their first principal component and cut into
    strips of equally many. Strips further apart than two vectors at the threshold can be
    don't meet. A table of up to STRIPS * strip_rows vectors has strips of strip_rows, a
    larger one STRIPS, until their bytes make it more.
    """
    placed = written(classes.mapInArrow(_leading(axes), "dim int, node long, m long, v array<double>, lead double"), "leading")
    placed = ranked(placed, ["dim"], ["lead", "node"], "strips")
    rows = F.least(F.greatest(F.ceil(F.col("n") / STRIPS), F.lit(strip_rows)), F.greatest(F.floor(F.lit(strip_bytes) / (8 * F.col("dim"))), F.lit(1)))
    placed = placed.withColumn("strip", F.floor(F.col("pos") / rows).cast("long"))
    ends = placed.groupBy("dim", "strip").agg(F.min("lead").alias("low"), F.max("lead").alias("high")).orderBy("dim", "strip").collect()  # one row for strip_bytes of vectors
    reach, partners = math.sqrt(2 - 2 * threshold + MARGIN), []
    for dim in dict.fromkeys(e.dim for e in ends):
        mine = [e for e in ends if e.dim == dim]
        low, high = np.array([e.low for e in mine]), np.array([e.high for e in mine])
        first, last = np.searchsorted(high, low - reach), np.searchsorted(low, high + reach, side="right") - 1
        partners += [(dim, k, int(first[k]), int(last[k])) for k in range(len(mine))]
    table = classes.sparkSession.createDataFrame(partners, "dim int, strip long, first long, last long")
    return placed.join(table, ["dim", "strip"]).select("dim", "node", "m", "v", "strip", F.explode(F.sequence("first", "last")).alias("to"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE, strip_bytes: int = STRIP_BYTES, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """One row per row of table: (vec_id, n_links, component_id, kept).

    Vectors of the same length link if their cosine, in double precision, is ``threshold``
    (over 0) or more. n_links counts the other rows that a row links with, component_id is
    the smallest id reachable over links, its own included, and the row with that id is
    kept. Vectors that are null, empty, zero or hold a null or a number that isn't finite
    link with nothing. Null ids keep their rows, link, and are never a smallest id; where
    all ids of a component are null its id is null and kept is false. Repeated ids and rows
    are rows of their own (and all kept where their id is the smallest). Other columns are
    not read; an empty table gives an empty one.

    Equal vectors (by two 64-bit hashes) are one node however many they are. The others are compared in strips:
    a task has two, of a bounded size, and gives of each vector the number of its links and
    one of its component, so that no pair leaves it. Every two strips that the bounds allow
    meet, which for vectors without any structure is all of them.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("sound", F.coalesce(F.col("v").isNotNull() & sound, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("sound"), F.struct(F.xxhash64(F.lit(1), "v").alias("a"), F.xxhash64(F.lit(2), "v").alias("b"))))
    ids = written(rows.select("vec_id", "key"), "ids")
    classes = rows.where("sound").groupBy("key").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = written(written(classes.withColumn("dim", F.size("v")), "distinct").withColumn("node", mixed_id()), "classes")

    lengths = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()}
    axes = {dim: principal(classes, dim) for dim in lengths if dim <= LONGEST_PCA}
    met = strips_of(classes.select("dim", "node", "m", "v"), threshold, axes, strip_bytes, strip_rows)
    met = met.select("dim", F.least("strip", "to").alias("a"), F.greatest("strip", "to").alias("b"), "strip", "node", "m", "v")
    found = written(met.groupBy("dim", "a", "b").applyInArrow(_compare(threshold, axes, tile), "node long, links long, peer long"), "found")

    labels = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "key", "m", "least").join(linked, "node", "left").join(labels, "node", "left")
    named = written(named.select("key", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ended = written(hot_join(named, least, "label").select("key", "n_links", "component_id"), "ended")
    sound_rows = hot_join(ids.where("key is not null"), ended, "key").select("vec_id", "n_links", "component_id")
    alone = ids.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound_rows.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and fate of every embedding: cosines of 0.9 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_near_vectors": op13_near_vectors}
ORACLES = {
    "op13_near_vectors": f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (SELECT * FROM rows WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.row, b.row AS other FROM sound a JOIN sound b ON a.row <> b.row AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reached AS (SELECT row, row AS other FROM rows UNION SELECT reached.row, links.other FROM reached JOIN links ON links.row = reached.other),
least AS (SELECT reached.row, min(r.vec_id) AS component_id FROM reached JOIN rows r ON r.row = reached.other GROUP BY reached.row),
counted AS (SELECT row, count(*) AS n FROM links GROUP BY row)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM rows JOIN least USING (row) LEFT JOIN counted USING (row)"""
}
