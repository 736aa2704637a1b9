"""Packs: the chunks of many runs in few files, in order of their runs, and a manifest of what each file holds."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import RUN_COLUMN, StoreError, quoted, valid_name

#: Bytes of a pack's file, and of the chunks that are worth packing.
FILE_BYTES, SMALL_BYTES = 128 << 20, 32 << 20
MANIFEST = "_manifest.json"
#: Text of which the least and the largest are kept whole.
TEXT = 100
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType, T.TimestampNTZType)


def plain(value):
    """A value as a manifest keeps it, in the same order as the values."""
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value


def compact(store, name: str, small: int = SMALL_BYTES, file_bytes: int = FILE_BYTES) -> int:
    """Pack the chunks of an append table that are under ``small`` bytes and not packed yet; the number of chunks packed.

    Their rows are written once more, under the table's present schema, in order of their
    runs and into files of about ``file_bytes``. The manifest beside the files names the
    first and the last run, the rows and the extremes of each column of every file. The commit
    points the chunks to the pack; every run, label and time reads as before. Rows of runs
    that are pruned later stay in the files and are left out when these are read. The
    folders that chunks were in are garbage, which collect_garbage() deletes. Runs that are
    under way are left alone, so a run lies in one pack.
    """
    store.log.replay()
    if store.log.shape(valid_name(name)) != "append":
        raise StoreError(f"{name} is no append table")
    loose = [c for c in store.log.chunks_of(name) if not c.get("pack")]
    ended = {i for i in {c["run_id"] for c in loose} if store.log.runs.get(i, {}).get("status") not in (None, "claimed", "queued")}
    going = [c for c in loose if c["run_id"] in ended and c["size_bytes"] < small]
    split = {c["run_id"] for c in loose if c not in going}  # a run with a large chunk stays as it is
    going = [c for c in going if c["run_id"] not in split]
    if len(going) < 2:
        return 0
    rows = store.chunk_rows(name, going)
    pack = f"data/{name}/pack={uuid.uuid4().hex}"
    folder = store.files.path(pack)
    parts = math.ceil(sum(c["size_bytes"] for c in going) / file_bytes)
    try:
        rows.repartitionByRange(parts, RUN_COLUMN).sortWithinPartitions(RUN_COLUMN).write.parquet(folder)
        manifest = _manifest(store.spark.read.schema(rows.schema).parquet(folder))
        if sum(f["rows"] for f in manifest) != sum(c["rows_appended"] for c in going):
            raise StoreError(f"the rows packed of {name} are not those appended; nothing has changed")
        text = json.dumps({"runs": len({c["run_id"] for c in going}), "files": manifest})
        store.files.create(f"{folder}/{MANIFEST}", text.encode())
        held = T.StructType(rows.schema.fields[:-2]).json()

        def build() -> list[dict]:
            there = {c["path"] for c in store.log.chunks_of(name) if not c.get("pack")}
            paths = [c["path"] for c in going if c["path"] in there]
            return [{"do": "chunk_pack", "name": name, "pack": pack, "schema": held, "paths": paths}] if paths else []

        store.log.commit(build)
    except BaseException:
        store.files.delete(folder)
        raise
    return len(going)


def _manifest(rows: DataFrame) -> list[dict]:
    """Of every file: its runs, rows and the extremes of its columns. One row a file comes to the driver."""
    columns = [f.name for f in rows.schema.fields[:-2] if isinstance(f.dataType, _ORDERED)]
    found = rows.withColumn("_file", F.col("_metadata.file_name")).groupBy("_file").agg(
        F.min(RUN_COLUMN).alias("first"), F.max(RUN_COLUMN).alias("last"), F.count("*").alias("rows"), *[f(quoted(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("low", F.min), ("high", F.max))]
    )
    out = []
    for r in found.collect():
        low, high = ({c: plain(r[f"{k}{i}"]) for i, c in enumerate(columns)} for k in ("low", "high"))
        high = {c: v for c, v in high.items() if not (isinstance(v, str) and len(v) > TEXT) and v == v}  # a cut text would be too low, NaN is above all
        out.append({"file": r["_file"], "first": r["first"], "last": r["last"], "rows": r["rows"], "low": {c: v[:TEXT] if isinstance(v, str) else v for c, v in low.items() if v == v}, "high": high})
    return sorted(out, key=lambda f: (f["first"], f["file"]))


def packed_rows(store, pack: str, chunks: list[dict], schema: T.StructType, run_id: str | None, between: dict) -> DataFrame | None:
    """The rows of chunks that lie in a pack: of the files that can hold the run asked for and values in the ranges."""
    manifest = store.manifest(pack)
    files = [f for f in manifest["files"] if (run_id is None or f["first"] <= run_id <= f["last"]) and _may_hold(f, between)]
    if not files:
        return None
    rows = store.spark.read.schema(schema).parquet(*[store.files.path(pack, f["file"]) for f in files])
    if run_id is not None:
        return rows.where(F.col(RUN_COLUMN) == run_id)
    live = {c["run_id"] for c in chunks}
    if len(live) == manifest["runs"]:
        return rows
    return rows.join(store.spark.createDataFrame([(r,) for r in live], f"`{RUN_COLUMN}` string"), RUN_COLUMN, "left_semi").select(*schema.names)


def _may_hold(f: dict, between: dict) -> bool:
    for column, (low, high) in between.items():
        least, most = f["low"].get(column), f["high"].get(column)
        if column in f["low"] and least is None:
            return False  # null throughout
        if high is not None and least is not None and least > plain(high) or low is not None and most is not None and most < plain(low):
            return False
    return True


def in_ranges(df: DataFrame, between: dict) -> DataFrame:
    for column, (low, high) in between.items():
        if low is not None:
            df = df.where(F.col(quoted(column)) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(quoted(column)) <= F.lit(high))
    return df


def checked(between: dict | None, columns: Iterable[str]) -> dict:
    """Ranges {column: (low, high)}, either end None for open."""
    names = set(columns)
    for column, ends in (between or {}).items():
        if column not in names or not isinstance(ends, tuple) or len(ends) != 2:
            raise StoreError(f"between is of columns and pairs of ends: {column!r}: {ends!r}")
    return between or {}
