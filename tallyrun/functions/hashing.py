"""Identity of tables, bytes, files and code."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def md5(data: bytes | str) -> str:
    return hashlib.md5(data.encode() if isinstance(data, str) else data).hexdigest()


def normal_code(text: str | bytes) -> bytes:
    """Code with line ends as LF, so that a checkout's line ends don't change identity."""
    data = text.encode() if isinstance(text, str) else text
    return data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")


def code_hash(own: str, helpers: list[str]) -> str:
    """Of a step's own hash and its helpers' hashes; the helpers' paths and order don't count."""
    return md5("\n".join([own, *sorted(helpers)]))


def plain(column: F.Column, kind: T.DataType) -> list[F.Column]:
    """Hashable columns that tell null from any value. Maps become entries in key order, nested values JSON that keeps nulls."""
    if isinstance(kind, T.MapType):
        column = F.array_sort(F.map_entries(column))
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        column = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    elif isinstance(kind, (T.VariantType,)):
        column = F.to_json(column)
    elif isinstance(kind, T.NullType):
        column = column.cast("string")
    return [column.isNull(), column]


def table_digest(df: DataFrame) -> tuple[str, int]:
    """Hash and number of rows of a table, in one pass with a state of a few numbers.

    Rows and columns may come in any order; repeated rows, types, names and the place of
    nulls count. A row has two 64-bit hashes; one is summed exactly and one is xor-ed, and
    both, the count and the sorted schema go into an md5. An empty table is its schema.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    parts = [c for f in fields for c in plain(df[_quoted(f.name)], f.dataType)] or [F.lit(0)]
    rows = df.select(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    n, total, mixed = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("a").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.coalesce(F.bit_xor("b"), F.lit(0))).first()
    schema = "|".join(f"{f.name}:{f.dataType.jsonValue()}" for f in fields)
    return md5(f"{schema}|{n}|{int(total)}|{mixed}"), n


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
