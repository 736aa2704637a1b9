"""Reading files into tables, and the digest that tells whether a file has changed."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import StoreError

#: Bytes of the largest file that an executor's task reads whole.
WHOLE = 128 << 20

READERS = {
    "csv": lambda r: r.options(header=True, inferSchema=True, sep=",").csv,
    "tsv": lambda r: r.options(header=True, inferSchema=True, sep="\t").csv,
    "parquet": lambda r: r.parquet,
    "pq": lambda r: r.parquet,
}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A csv, tsv, parquet or pq file (or folder of such) as a table."""
    if "\0" in path:
        raise StoreError("a path has no NUL")
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in READERS:
        raise StoreError(f"{path}: only {', '.join(READERS)} files can be read")
    if not _files(spark, path):
        raise StoreError(f"{path} does not exist")
    return READERS[kind](spark.read)(path)


def _files(spark: SparkSession, path: str) -> list:
    """Statuses of a file, or of the files below a folder, in path order."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    walk, out = fs.listFiles(place, True), []
    while walk.hasNext():
        out.append(walk.next())
    return sorted(out, key=lambda s: s.getPath().toString())


def file_digest(spark: SparkSession, path: str) -> str:
    """md5 of a file's bytes; of a folder's, md5 of the paths below it and the md5s of its files.

    Files of a folder are read by the executors, but for those over WHOLE bytes, which no
    task could hold: these go through streams, a few at a time, as a single file does. A
    line for each file comes to the driver, which lists them to scan them anyway.
    """
    found = _files(spark, path)
    if not found:
        raise StoreError(f"{path} does not exist")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(place).isFile():
        return _streamed(spark, found[0].getPath())
    root = fs.makeQualified(place).toString().rstrip("/")
    small = [s.getPath().toString() for s in found if s.getLen() <= WHOLE]
    digests = {}
    if small:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= WHOLE).selectExpr("path", "md5(content) AS h").collect()
        digests = {r.path: r.h for r in rows}
    rest = [s.getPath() for s in found if s.getPath().toString() not in digests]
    with ThreadPoolExecutor(4) as pool:
        digests |= dict(zip([p.toString() for p in rest], pool.map(lambda p: _streamed(spark, p), rest), strict=True))
    return hashlib.md5("\n".join(sorted(f"{p.removeprefix(root)} {h}" for p, h in digests.items())).encode()).hexdigest()


def _streamed(spark: SparkSession, place) -> str:
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream)
    finally:
        stream.close()
