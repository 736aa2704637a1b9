"""Schemas of the tables about the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

_PAIR = T.StructType([T.StructField("name", T.StringType()), T.StructField("hash", T.StringType())])
_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType())])
_OUTPUT = T.StructType([T.StructField(n, k) for n, k in (("kind", T.StringType()), ("name", T.StringType()), ("hash", T.StringType()), ("rows_appended", T.LongType()))])
_REBIND = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "source", "value", "hash", "shape", "filter_kind", "filter_value")])
_PACKAGE = T.StructType([T.StructField("pkg", T.StringType()), T.StructField("ver", T.StringType())])
_KINDS = {
    "inputs": T.ArrayType(_PAIR), "outputs": T.ArrayType(_OUTPUT), "helpers": T.ArrayType(_FILE), "rebinds": T.ArrayType(_REBIND), "attached_packages": T.ArrayType(_PACKAGE),
    "external_inputs": T.StructType([T.StructField("files", T.ArrayType(_FILE)), T.StructField("env", T.ArrayType(_PAIR))]), "started_at": T.TimestampNTZType(), "queued_at": T.TimestampNTZType(),
    "duration_ms": T.LongType(), "seed": T.DoubleType(), "n_cpu": T.IntegerType(), "total_ram_bytes": T.LongType(), "free_ram_bytes": T.LongType(), "materialize": T.BooleanType(), "git_dirty": T.BooleanType(),
    "first_seen": T.TimestampNTZType(), "last_seen": T.TimestampNTZType(), "size_bytes": T.LongType(), "is_rebind": T.BooleanType(), "rows_appended": T.LongType(), "row_count": T.LongType(), "n_runs": T.LongType(),
    "first_run": T.TimestampNTZType(), "last_run": T.TimestampNTZType(), "produced_by_runs": T.ArrayType(T.StringType()), "used_by_this_script": T.BooleanType(), "rows_pruned": T.LongType(), "seq": T.LongType(),
}


def schema(columns: tuple[str, ...] | list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in columns])


RUNS = (
    "step", "run_id", "inputs", "outputs", "started_at", "duration_ms", "status", "code_hash", "external_inputs", "helpers", "variant_label", "code_body", "seed", "rebinds", "batch_id",
    "hostname", "os", "arch", "runtime_version", "n_cpu", "total_ram_bytes", "free_ram_bytes", "attached_packages", "git_sha", "git_branch", "git_dirty", "queued_at", "materialize",
)
VERSIONS = ("logical_name", "content_hash", "physical_name", "kind", "first_seen", "last_seen", "size_bytes", "storage_location", "source_uri", "source_hash", "source_sql", "is_rebind")
TABLES = ("logical_name", "physical_name", "schema", "first_seen", "last_seen", "row_count", "size_bytes")
CHUNKS = ("logical_name", "run_id", "chunk_hash", "rows_appended", "started_at", "variant_label", "source_plan")


def _value(column: str, v):
    if v is not None and isinstance(_KINDS.get(column), T.TimestampNTZType):
        return datetime.fromisoformat(v)
    if column == "outputs" and v is not None:
        return [{"kind": o.get("kind"), "name": o.get("name", o.get("logical_name")), "hash": o.get("hash", o.get("chunk_hash")), "rows_appended": o.get("rows_appended")} for o in v]
    return v


def frame(spark, rows: list[dict], columns):
    """A DataFrame of metadata rows."""
    return spark.createDataFrame([tuple(_value(c, r.get(c)) for c in columns) for r in rows], schema(columns))
