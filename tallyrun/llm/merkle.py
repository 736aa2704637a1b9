"""A Merkle manifest of a table: DuckDB hashes aligned blocks of leaves level by level, Spark joins their roots and proofs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, documents, ranked, written

#: Levels that one block has: 4096 nodes.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of documents, the share (one in so many ids by their crc) whose n_chars is tampered with.
TAMPER = 7


def _level_query(levels: int) -> str:
    """Over n0(r, b, pos, levels, h): of each row r the siblings on its way up its block b, and the block's root.

    Every level is a GROUP BY that joins the digests of two neighbours in order and hashes
    them. A block ends after its own number of levels.
    """
    parts = [f"n{k + 1} AS MATERIALIZED (SELECT b, pos >> 1 AS pos, any_value(levels) AS levels, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM n{k} WHERE levels > {k} GROUP BY b, pos >> 1)" for k in range(levels)]
    tops = " UNION ALL ".join(f"SELECT b, h FROM n{k} WHERE levels = {k}" for k in range(levels + 1))
    left = ", ".join(f"CASE WHEN (n0.pos >> {k}) % 2 = 1 THEN s{k}.h ELSE '' END" for k in range(levels))
    right = ", ".join(f"CASE WHEN (n0.pos >> {k}) % 2 = 0 THEN coalesce(s{k}.h, '') ELSE '' END" for k in range(levels))
    joins = " ".join(f"LEFT JOIN n{k} s{k} ON s{k}.b = n0.b AND s{k}.pos = xor(n0.pos >> {k}, 1)" for k in range(levels))
    return f"WITH {', '.join(parts)}, tops AS ({tops}) SELECT [{left}][1:n0.levels] AS lefts, [{right}][1:n0.levels] AS rights, tops.h AS root FROM n0 {joins} JOIN tops ON tops.b = n0.b ORDER BY n0.r"


def _hash_blocks(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    query = _level_query(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by tree and place; blocks that are there as a whole are hashed together."""
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < 1 << levels:
                continue
            held = pa.Table.from_batches(kept).combine_chunks()
            last = int(_blocks(held, levels)[1][-1])  # the last block may go on in the next batch
            if last:
                yield from hashed(con, held.slice(0, last))
            kept = held.slice(last).to_batches()
        if kept:
            yield from hashed(con, pa.Table.from_batches(kept).combine_chunks())
        con.close()

    def hashed(con: duckdb.DuckDBPyConnection, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = rows.column("n").to_numpy()
        tall = np.zeros(len(n), np.int32)
        for k in range(levels):
            tall += ((n - 1) >> k) > 0
        con.register("n0", pa.table({"r": np.arange(len(n)), "b": _blocks(rows, levels)[0], "pos": rows.column("pos"), "levels": tall, "h": rows.column("h")}))
        found = con.sql(query).to_arrow_table()
        con.unregister("n0")
        for name in ("lefts", "rights"):
            rows = rows.append_column(name, found.column(name).cast(pa.list_(pa.string())))
        yield from rows.append_column("root", found.column("root").cast(pa.string())).combine_chunks().to_batches()

    return run


def _blocks(rows: pa.Table, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's block, and where each block begins."""
    trees = rows.column("tree").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    block = rows.column("pos").to_numpy() >> levels
    new = np.concatenate(([True], (trees[1:] != trees[:-1]) | (block[1:] != block[:-1])))
    return np.cumsum(new) - 1, np.flatnonzero(new)


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (tree, pos, n, h, ...) with their siblings up to the root of their block and that root: lefts, rights, root."""
    block = F.shiftright("pos", levels)
    ready = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "pos")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema)
    return ready.mapInArrow(_hash_blocks(levels), f"{kinds}, lefts array<string>, rights array<string>, root string")


def climbed(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Nodes (tree, pos, n, h, ...) with all their siblings up to the root of their tree: lefts, rights, root.

    A tree of more than one block goes on with its blocks' roots as the nodes of a tree that
    is 2 ** levels times smaller.
    """
    inner = written(in_blocks(nodes, levels), "blocks")
    if inner.where(F.col("n") > 1 << levels).isEmpty():
        return inner.drop("block")
    return _with_outer(inner, climbed(_roots(inner, levels), levels))


def _roots(inner: DataFrame, levels: int) -> DataFrame:
    size = F.ceil(F.first("n") / F.lit(float(1 << levels))).cast("long")
    return inner.groupBy("tree", "block").agg(size.alias("n"), F.first("root").alias("h")).withColumnRenamed("block", "pos")


def _with_outer(inner: DataFrame, outer: DataFrame, *more: str) -> DataFrame:
    up = outer.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("lefts").alias("_lefts"), F.col("rights").alias("_rights"), F.col("root").alias("_root"), *more)
    both = inner.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    kept = [c for c in inner.columns if c not in ("block", "lefts", "rights", "root")]
    return both.select(*kept, F.concat("lefts", "_lefts").alias("lefts"), F.concat("rights", "_rights").alias("rights"), F.col("_root").alias("root"), *more)


def leaf(fields: list[F.Column]) -> F.Column:
    """sha256 of the fields one after the other: "-" for null, else length in bytes, colon and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(digest: F.Column, lefts: F.Column, rights: F.Column) -> F.Column:
    """The root that a leaf's digest and its siblings lead to."""
    steps = F.zip_with(lefts, rights, lambda left, right: F.struct(left.alias("left"), right.alias("right")))
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, altered: dict[str, F.Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lefts, rights).

    A leaf is the digest of a row's ``fields``. Of each value of ``tree_col`` (null is one,
    and comes first) the leaves in order of id make a tree of pairs, where a node without a
    neighbour is hashed alone, up to a subroot; the subroots in order of ``tree_col`` make
    the tree to the root in the same way. lefts and rights are the siblings of a leaf from
    below ("" where there is none on that side), proof_sha256 is the digest of them all in
    that order. ``altered`` maps fields to other values; folded_root is what a leaf made
    from these and the proof lead to, and verified whether that is the root.

    Null ids come first; repeated ids are ordered by their leaves, so equal rows are
    neighbours in any order with the same outcome. Null and empty fields differ. A table of
    one row has its leaf as root and an empty proof; an empty table gives no rows. Other
    columns are not read.

    A block of 2 ** levels neighbours is hashed in one task from its digests alone, and a
    tree's blocks are spread over tasks, so neither a long tree nor a long text is a burden.
    Block roots go up as nodes of a smaller tree; nothing comes to the driver.
    """
    plain = [F.col(f) for f in fields]
    changed = [(altered or {}).get(f, F.col(f)) for f in fields]
    same = F.lit(True)
    for a, b in zip(plain, changed, strict=True):
        same = same & a.eqNullSafe(b)
    leaves = docs.select(F.col(id_col).alias("id"), F.col(tree_col).cast("string").alias("tree"), leaf(plain).alias("h"), F.when(~same, leaf(changed)).alias("other"))
    placed = ranked(written(leaves, "leaves"), ["tree"], ["id", "h"])
    inner = written(in_blocks(placed, levels), "blocks")
    blocks = written(climbed(_roots(inner, levels), levels), "roots")

    tops = written(blocks.where("pos = 0").select(F.col("tree").alias("name"), F.col("root").alias("h")), "subroots")
    top = climbed(ranked(tops.withColumn("tree", F.lit("")), ["tree"], ["name"]), levels)
    top = top.select("name", F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), F.col("root").alias("top"))
    outer = blocks.join(top, F.col("tree").eqNullSafe(F.col("name")))
    outer = outer.select("tree", "pos", F.concat("lefts", "up_lefts").alias("lefts"), F.concat("rights", "up_rights").alias("rights"), F.col("root"), "top")

    proved = _with_outer(inner, outer, "top")
    proof = F.sha2(F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), ""), 256)
    folded = proved.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), proof.alias("proof_sha256"), fold(F.coalesce("other", "h"), F.col("lefts"), F.col("rights")).alias("folded_root"), "lefts", "rights")
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> dict[str, F.Column]:
    """One added to n_chars where TAMPER divides the crc of the id."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, checked after tampering with some."""
    docs = documents(spark, sf_dir)
    return manifest(docs, altered=tampered(docs)).drop("lefts", "rights")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def _leaf_sql(n_chars: str) -> str:
    fields = [n_chars if f == "n_chars" else f for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


ORACLES = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
hit AS (SELECT *, doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % {TAMPER} = 0 AS hit FROM documents, crc),
leaves AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("CASE WHEN hit THEN n_chars + 1 ELSE n_chars END")} AS other FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), tall AS (SELECT lang, max(level) AS tall FROM low GROUP BY lang),
named AS (SELECT row_number() OVER () AS row, p.*, s.subroot, s.pos AS top, t.tall FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN tall t ON p.lang IS NOT DISTINCT FROM t.lang),
steps AS (
  SELECT row, u.level, (named.pos >> u.level) % 2 = 1 AS odd, s.h FROM named, unnest(range(tall)) AS u(level)
    LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM named.lang AND s.level = u.level AND s.pos = xor(named.pos >> u.level, 1)
  UNION ALL
  SELECT row, tall + u.level, (named.top >> u.level) % 2 = 1, s.h FROM named, unnest(range((SELECT max(level) FROM high))) AS u(level)
    LEFT JOIN high s ON s.level = u.level AND s.pos = xor(named.top >> u.level, 1)
), proofs AS (SELECT row, list((CASE WHEN odd THEN '<' ELSE '>' END) || coalesce(h, '') ORDER BY level) AS path FROM steps GROUP BY row),
folded AS (
  SELECT named.*, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s[2:]), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend(other, coalesce(path, [])), lambda acc, s: sha256(CASE WHEN s[1] = '<' THEN s[2:] || acc ELSE acc || s[2:] END)) AS folded_root
  FROM named LEFT JOIN proofs USING (row)
)
SELECT doc_id, leaf, subroot, high.h AS root, proof_sha256, folded_root, folded_root = high.h AS verified FROM folded, high WHERE high.n = 1"""
}
