"""What the operators share: shared-folder tables, text batches and words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (and text is cut at these alone).
BLANKS = " \t\n\v\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text that a Python task holds at a time.
BATCH_ROWS, BATCH_BYTES = 4096, 24 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyrun-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_SCRATCH: list[list] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written in this block go at its end, but for those written to be kept."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for fs, place in _SCRATCH.pop():
            fs.delete(place, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder, which cuts the lineage.

    The table survives the loss of executors. It is removed at the end of the innermost
    scratch block unless ``keep`` is set, and else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyrun-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(place)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append((fs, place))
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: int | str = "text", rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none has more than so many rows or bytes of the text column (one row at least).

    When the next is asked for, memory that the last one left unused goes back to the system: Python
    workers live on from stage to stage beside the JVM.
    """
    for batch in batches:
        column = batch.column(text)
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and column.slice(start, n).nbytes > size:
                n = max(1, n // 2)
            yield batch.slice(start, n)
            start += n
            give_back()


def give_back() -> None:
    """Return free memory of the allocators to the system, where they can."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim
    except (OSError, AttributeError):
        return None
    return libc


_LIBC = _libc()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def word_bytes(text: str) -> list[bytes]:
    """Words as UTF-8: bytes.split() cuts at exactly the six blanks."""
    return text.encode().split()


def word_count(column: str) -> F.Column:
    """Number of words as a native expression (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def words_of(text: str) -> list[str]:
    return re.findall(WORD_PATTERN, text)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "ranked") -> DataFrame:
    """The rows with their place ``pos`` (from 0) in their group of ``by`` and its size ``n``, from a written table.

    Rows are ordered by ``order`` (nulls first; equal rows in any order). They are dealt by
    range and counted by group and partition; places before a partition are sums of such
    counts, so no group comes into one task. ``df`` is planned twice: make it a written table.
    """
    whole = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = written(whole.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    counts = rows.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    mine = W.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(mine.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("__part"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(mine).alias("n"))
    same = F.col("_part") == F.col("__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(counts, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias("pos"), "n")


def hot_join(rows: DataFrame, table: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """rows joined with a table that has one row a key, where a few keys may have most rows.

    A key's rows are split in ``salts`` by their hash; the table's row goes to those that
    are there, so it is copied no more often than it has rows to meet.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    there = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(there, [key, "_salt"]).drop("_salt")


def mixed_id() -> F.Column:
    """A number for each row of a written table, different for every row and spread like a hash (xorshift is one to one)."""
    x = F.monotonically_increasing_id() + 1
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


#: One row with the table of CRC-32 (reflected polynomial 0xEDB88320) as a DuckDB list ``t``, and the crc of a list of bytes with it.
CRC_TABLE_SQL = "SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes; ``t`` is the list of CRC_TABLE_SQL."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)))"
