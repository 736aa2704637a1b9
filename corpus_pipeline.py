"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's rows as Parquet in the shared folder and
reads them back for the next. The rows have no SQL form (SimHash groups and string removal
do not), so ORACLE_SQL is None and the tests compare run() with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.llm import common, mixing, near_copies, packing, quality, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word and repetition rules go. Each row is judged where it is read, so no text is moved."""
    return quality.quality(docs, carry=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) one row stays: of the smallest id, a null id being last."""
    rows = common.written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    copies = near_copies.near_copies(rows, id_col="_row").withColumnRenamed("doc_id", "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row").alias("row")))["row"]
    kept = copies.join(rows.select("_row", "doc_id"), "_row").groupBy("component").agg(first.alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go from the texts; n_chars follows. A character cut in two goes whole. Texts that lose all they have stay as empty ones, null ones as null."""
    marked = docs.withColumn("none", F.col("text").isNull())
    kept = suffix_dedup.remove_repeats(marked, carry=("none", "lang", "source", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "kept", size=8 << 20):
            rows = zip(*(batch.column(c).to_pylist() for c in ("none", "kept", "n_removed", "n_chars")), strict=True)
            texts = [(None if none else (t := left.decode("utf-8", "ignore")), len(t) if gone else n) for none, left, gone, n in rows]
            columns = [batch.column("doc_id"), pa.array([t for t, _ in texts], pa.string()), batch.column("lang"), batch.column("source"), pa.array([n for _, n in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, COLUMNS)

    slim = kept.select("doc_id", "none", "kept", "n_removed", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return slim.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", string_dedup),
    ("mixing sources", source_mix),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep. What a stage writes besides its rows goes when these are written."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        with common.scratch():
            docs = common.written(stage(spark, docs, sf_dir), f"stage{k}", keep=True)
    return docs
