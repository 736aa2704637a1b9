"""Mixing sources to target weights by systematic sampling, in native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: Random offsets drawn for each source; the one that takes nearest the target is used.
DRAWS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: (source, source_size, target).

    sizes: (source, source_size), one row per source, a null source being one of them.
    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes. A target stops at ``most`` times its source's size; what is over is shared
    again by weight until none is above. Filling sources in order of size per weight finds
    the same targets in one pass: those full come first, the rest share what is left. This
    runs in one task, over a row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    ranked = sizes.select("source", F.col("source_size").cast("long"), F.element_at(F.array(*map(F.lit, weights)), turn).cast("double").alias("w"))
    full = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everyone = fill.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everyone).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = full.withColumn("level", level).withColumn("n", F.row_number().over(fill))
    first = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("n", "level"))).over(everyone)
    done = filled.withColumn("first", first)
    return done.select("source", "source_size", F.when(F.col("first").isNull() | (F.col("n") < F.col("first.n")), F.col("cap")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", size: F.Column | None = None, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, draws: int = DRAWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, copies, taken), then the columns of ``carry``.

    Every document of a source expects target / source_size copies. The expected copies
    are summed up along the source, one random offset is added, and a document is taken
    once for each integer that its stretch of the sum crosses; taken is size times copies.
    Along a source, documents go by size class (bit length and leading bits of the size),
    slice and size, so that what is taken comes near the target for sizes of any spread. A
    slice is the first byte of the md5 of the id: no window holds more than one slice of
    one class of one source, however large that source is, and the sums of the slices give
    the start of each. ``draws`` offsets are drawn from the md5 of seed, number and source, so
    reruns agree, and the one is used whose words come nearest the target: one long document
    can be a large part of a small source.

    A null source is a source of its own; a null size or id counts as 0 or as the empty id;
    documents without words take 0 words (and keep their copies). Repeated rows are rows of
    their own. An empty table gives an empty one. Other columns are not read.
    """
    words = size if size is not None else word_count("text")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    digits = F.bin(F.col("size"))
    slim = slim.select("*", F.length(digits).alias("bits"), F.substring(digits, 1, 3).alias("lead"), F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2).alias("slice"))
    slim = written(slim, "sizes")
    keys = ["source", "bits", "lead", "slice"]
    parts = written(slim.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("size").alias("words")), "slices")
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    along = W.partitionBy("source").orderBy("bits", "lead", "slice")
    parts = parts.select(*keys, (F.sum("rows").over(along) - F.col("rows")).alias("before"))
    drawn = [F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) for k in range(draws)]
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = written(targets.select("source", "source_size", "target", each.alias("each"), F.array(*drawn).alias("offsets")), "targets")
    keyed = lambda df: df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys], F.col("source").isNull().alias("_none"), *[c for c in df.columns if c not in keys])
    on = [f"_{k}" for k in keys] + ["_none"]
    starts = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select(*[F.col(f"p.{k}").alias(k) for k in keys], "before", "source_size", "target", "each", "offsets")
    # Small as a file, not in memory, and growing with the input: never broadcast.
    starts = written(keyed(starts), "starts").hint("merge")
    here = W.partitionBy(*on).orderBy("size", "doc_id", *[f"carry_{c}" for c in carry])
    placed = written(keyed(slim).withColumn("at", F.row_number().over(here)), "placed")
    rank = F.col("before") + F.col("at")
    upto = lambda n, offset: F.floor(n.cast("double") * F.col("each") + offset)
    copies = lambda offset: (upto(rank, offset) - upto(rank - 1, offset)).cast("long")
    sums = placed.join(starts, on).groupBy("_source", "_none").agg(F.array(*[F.sum(copies(F.col("offsets")[k]) * F.col("size")) for k in range(draws)]).alias("sums"), F.first("target").alias("goal"), F.first("offsets").alias("drawn"))
    errors = sums.withColumn("errors", F.transform("sums", lambda x: F.abs(x.cast("double") - F.col("goal"))))
    best = errors.select("_source", "_none", F.element_at("drawn", F.array_position("errors", F.array_min("errors")).cast("int")).alias("offset"))
    final = starts.drop("offsets").join(written(best, "offsets"), ["_source", "_none"]).hint("merge")
    return placed.join(final, on).select("doc_id", "size", "source_size", "target", copies(F.col("offset")).alias("copies"), (copies(F.col("offset")) * F.col("size")).alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Rows are told apart by a number of their own, so null and repeated ids are rows like any other.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    taken = mix(rows, **options, carry=("_row",)).where("copies > 0").select("_row", "copies")
    rows = rows.join(taken.withColumnRenamed("copies", "_copies"), "_row")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op2_source_mixing": op2_source_mixing}

ORACLES = {
    "op2_source_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, length(bin(size)) AS bits, substr(bin(size), 1, 3) AS lead, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS slice FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT *, row_number() OVER o AS n,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), free AS (
  SELECT min(n) AS n, min_by(level, n) AS level FROM levels WHERE cap / w > level
), targets AS (
  SELECT source, source_size, CASE WHEN free.n IS NULL OR levels.n < free.n THEN cap ELSE free.level * w END AS target FROM levels CROSS JOIN free
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bits, lead, slice, size, doc_id) AS rank FROM keyed
), draws AS (
  SELECT source, k, ('0x' || substr(md5('{SEED}:' || k || ':' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM sources, (SELECT unnest(range(0, {DRAWS})) AS k)
), expected AS (
  SELECT doc_id, size, r.source, source_size, target, rank, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), tried AS (
  SELECT e.source, k, u, abs(sum((floor(rank::DOUBLE * each + u) - floor((rank - 1)::DOUBLE * each + u))::BIGINT * size)::DOUBLE - min(target)) AS error
  FROM expected e JOIN draws d ON e.source IS NOT DISTINCT FROM d.source GROUP BY ALL
), chosen AS (
  SELECT source, arg_min(u, (error, k)) AS u FROM tried GROUP BY source
), counted AS (
  SELECT e.*, (floor(rank::DOUBLE * each + u) - floor((rank - 1)::DOUBLE * each + u))::BIGINT AS copies FROM expected e JOIN chosen c ON e.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted"""
}
