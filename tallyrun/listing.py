"""Listings of versions, variants and what a script has not used: plans over the log's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema as metadata
from .names import StoreError
from .store import Store

_VERSIONS = ("logical_name", "content_hash", "kind", "first_seen", "last_seen", "size_bytes", "is_rebind", "rows_appended", "source_uri", "source_sql", "produced_by_runs")


def written_by_runs(store: Store) -> DataFrame:
    """What runs have written: (run_id, seq, started_at, variant_label, name, hash), a row for each output."""
    rows = store.log.runs.frame().select("run_id", "seq", "started_at", "variant_label", F.explode("outputs").alias("o"))
    return rows.select("run_id", "seq", "started_at", "variant_label", "o.name", "o.hash")


def _as_listed(df: DataFrame, **columns: F.Column) -> DataFrame:
    kinds = metadata.schema(_VERSIONS)
    return df.select(*[columns.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def versions(store: Store, name: str, include_rebinds: bool = True) -> DataFrame:
    """Versions of a name (chunks of an append table), newest first, with the runs that made each."""
    store.log.replay()
    shape = store.log.shape(name)
    if shape is None:
        raise StoreError(f"nothing is stored as {name}")
    if shape == "append":
        rows = store.log.chunk_frame().where(F.col("logical_name") == name).orderBy(F.col("seq").desc())
        return _as_listed(rows, content_hash=F.col("chunk_hash"), kind=F.lit("chunk"), first_seen=F.col("started_at"), last_seen=F.col("started_at"), is_rebind=F.lit(False), produced_by_runs=F.array("run_id"))
    rows = store.log.versions.frame().where(F.col("logical_name") == name)
    if not include_rebinds:
        rows = rows.where(~F.coalesce("is_rebind", F.lit(False)))
    made = written_by_runs(store).where(F.col("name") == name).groupBy(F.col("hash").alias("content_hash")).agg(F.array_sort(F.collect_set(F.struct("seq", "run_id"))).alias("makers"))
    both = rows.join(made, "content_hash", "left").orderBy(F.col("first_seen").desc(), F.col("seq").desc())
    return _as_listed(both, produced_by_runs=F.coalesce(F.col("makers.run_id"), F.array()))


def variants(store: Store, script: str | None = None, name: str | None = None) -> DataFrame:
    """Labelled steps: (step, variant_label, first_run, last_run, n_runs, latest_run_id), the newest first. name: only those with a run that wrote it."""
    runs = store.runs().where("variant_label is not null and started_at is not null")
    if script is not None:
        runs = runs.where(F.col("step") == script)
    if name is not None:
        runs = runs.where(F.exists("outputs", lambda o: o["name"] == name))
    grouped = runs.groupBy("step", "variant_label").agg(F.min("started_at").alias("first_run"), F.max("started_at").alias("last_run"), F.count("*").alias("n_runs"), F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest_run_id"))
    return grouped.orderBy(F.col("last_run").desc(), "step", "variant_label")


def variants_unexplored(store: Store, script: str) -> DataFrame:
    """Labelled results of the names that a script reads, newest first, and whether it has read each: (logical_name, upstream_label, upstream_hash, last_seen, used_by_this_script)."""
    store.log.replay()
    used = store.log.runs.frame().where(F.col("step") == script).select(F.explode("inputs").alias("p")).select("p.name", "p.hash").distinct()
    labelled = written_by_runs(store).where("variant_label is not null and started_at is not null")
    found = labelled.join(used.select("name").distinct(), "name", "left_semi").groupBy("name", "hash", "variant_label").agg(F.max(F.struct("started_at", "seq")).alias("last"))
    both = found.join(used.withColumn("used", F.lit(True)), ["name", "hash"], "left").orderBy(F.col("last").desc(), "name", "hash")
    return both.select(F.col("name").alias("logical_name"), F.col("variant_label").alias("upstream_label"), F.col("hash").alias("upstream_hash"), F.col("last.started_at").alias("last_seen"), F.coalesce("used", F.lit(False)).alias("used_by_this_script"))
