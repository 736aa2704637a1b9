"""Pruning: old versions, old chunks and runs of a label."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schema as metadata
from .functions.scalars import duration
from .listing import written_by_runs
from .log import stamp
from .names import StoreError, valid_name
from .store import Store

#: Folders that the driver deletes at a time.
DELETES = 16


def prune(store: Store, name: str | None = None, by: str = "auto", run_id: str | None = None, keep: int | None = None, keep_latest: bool = False, older_than: str | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Remove what the policies select, and say what: {"versioned": ..., "append": ...}.

    Versions go if they are not the newest (keep_latest), not among the newest ``keep``, or
    were first seen longer ago than older_than; a version that a run has written stays
    unless force is set. Chunks go by run: run_id, not among the newest ``keep``, older_than,
    or not the newest of their label (keep_latest); labelled runs stay unless force or
    keep_latest is set. The commit comes first; data it no longer names is then deleted.
    """
    if by not in ("auto", "version", "run", "age"):
        raise StoreError("by is auto, version, run or age")
    if keep is not None and keep < 0:
        raise StoreError("keep is not negative")
    if keep is not None and keep_latest:
        raise StoreError("keep_latest or keep, not both")
    store.log.replay()
    shape = store.log.shape(valid_name(name)) if name is not None else None
    if name is not None and by == "auto":
        by = "run" if shape == "append" else "version"
    if name is not None and by == "version" and shape == "append":
        raise StoreError(f"{name} is an append table; prune it by run")
    if name is not None and by == "run" and shape == "versioned":
        raise StoreError(f"{name} is versioned; prune it by version")
    if by == "age":
        if older_than is None:
            raise StoreError("by age needs older_than")
        run_id, keep, keep_latest = None, None, False
    limit = stamp(store._clock() - duration(older_than)) if older_than is not None else None
    out = {}
    if by in ("auto", "version", "age"):
        out["versioned"] = _prune_versions(store, name, keep, keep_latest, limit, force)
    if by in ("auto", "run", "age"):
        out["append"] = _prune_chunks(store, name, run_id, keep, keep_latest, limit, force)
    return out


def _prune_versions(store: Store, name, keep, keep_latest, limit, force) -> DataFrame:
    going: list[dict] = []

    def build() -> list[dict]:
        going[:] = _old_versions(store, name, keep, keep_latest, limit, force)
        return [{"do": "version_delete", "name": v["logical_name"], "hash": v["content_hash"]} for v in going]

    store.log.commit(build)
    for v in going:
        store._live_views.pop((v["logical_name"], v["content_hash"]), None)
    _delete(store, (v["path"] for v in going if v.get("path")))
    return metadata.frame(store.spark, going, metadata.VERSIONS)


def _any(conditions: list[F.Column]) -> F.Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _before(column: str, limit: str) -> F.Column:
    return F.col(column) < F.lit(limit).cast("timestamp_ntz")


def _old_versions(store: Store, name, keep, keep_latest, limit, force) -> list[dict]:
    """Places by age within each name, and those that no run has written: a window and an anti-join over the log. Only what goes comes to the driver."""
    if not (keep_latest or keep is not None or limit is not None):
        return []
    rows = store.log.versions.frame(row=True)
    if name is not None:
        rows = rows.where(F.col("logical_name") == name)
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("logical_name").orderBy(F.col("first_seen").desc(), F.col("seq").desc())))
    old = [F.col("place") > (1 if keep_latest else keep)] if keep_latest or keep is not None else []
    going = rows.where(_any([*old, *([_before("first_seen", limit)] if limit is not None else [])]))
    if not force:
        written = written_by_runs(store).select(F.col("name").alias("logical_name"), F.col("hash").alias("content_hash"), F.lit(True).alias("written")).distinct()
        going = going.join(written, ["logical_name", "content_hash"], "left")
        safe = going.where("written").count()
        if safe:
            warnings.warn(f"{safe} versions are results of runs and stay; force=True removes them", stacklevel=6)
        going = going.where("written is null")
    return [json.loads(r.row) for r in going.orderBy("logical_name", "first_seen", "seq").select("row").toLocalIterator()]


def _delete(store: Store, paths: Iterable[str]) -> None:
    """Some at a time: each is a call to the file system that removes a folder as a whole."""

    def one(path: str) -> None:
        try:
            store.files.delete(store.files.path(path))
        except Exception as e:  # the commit stands; what is left over is only garbage
            warnings.warn(f"{path} could not be deleted: {e}", stacklevel=2)

    with ThreadPoolExecutor(DELETES) as pool:
        list(pool.map(one, paths))


def _prune_chunks(store: Store, name, run_id, keep, keep_latest, limit, force) -> DataFrame:
    rows: list[dict] = []
    going: list[dict] = []

    def build() -> list[dict]:
        rows[:], going[:] = _old_chunks(store, name, run_id, keep, keep_latest, limit, force)
        return [{"do": "chunk_delete", "path": c["path"]} for c in going]

    store.log.commit(build)
    _delete(store, (c["path"] for c in going))
    return metadata.frame(store.spark, rows, ("logical_name", "rows_pruned"))


def _old_chunks(store: Store, name, run_id, keep, keep_latest, limit, force) -> tuple[list[dict], list[dict]]:
    """Runs by age within each table and label, less the labelled ones: windows over chunks joined with runs, and a semi-join back."""
    tables = [t for t in store.log.tables if name in (None, t)]
    chunks = store.log._chunks.frame(row=True)
    if name is not None:
        chunks = chunks.where(F.col("logical_name") == name)
    runs = store.log.runs.frame().select("run_id", F.col("started_at").alias("began"), F.col("variant_label").alias("label"), F.col("seq").alias("run_seq"))
    held = chunks.select("logical_name", "run_id").distinct().join(runs, "run_id", "left")
    newest = [F.col("began").desc_nulls_last(), F.col("run_seq").desc()]
    conditions = [F.col("run_id") == run_id] if run_id else []
    if limit is not None:
        conditions.append(_before("began", limit))
    if keep is not None:
        held = held.withColumn("place", F.row_number().over(W.partitionBy("logical_name").orderBy(*newest)))
        conditions.append(F.col("began").isNotNull() & (F.col("place") > keep))
    if keep_latest:
        held = held.withColumn("of_label", F.row_number().over(W.partitionBy("logical_name", "label").orderBy(*newest)))
        conditions.append(F.col("began").isNotNull() & (F.col("of_label") > 1))
    doomed = held.where(F.coalesce(_any(conditions), F.lit(False)))
    if not force and not keep_latest and conditions:
        for r in doomed.where("label is not null").groupBy("logical_name").count().collect():
            warnings.warn(f"{r['count']} labelled runs of {r.logical_name} stay; force=True removes them", stacklevel=6)
        doomed = doomed.where("label is null")
    going = [json.loads(r.row) for r in chunks.join(doomed.select("logical_name", "run_id"), ["logical_name", "run_id"], "left_semi").orderBy("seq").select("row").toLocalIterator()] if conditions else []
    pruned = dict.fromkeys(tables, 0)
    for c in going:
        pruned[c["logical_name"]] = pruned.get(c["logical_name"], 0) + c["rows_appended"]
    return [{"logical_name": t, "rows_pruned": n} for t, n in pruned.items()], going


def collect_garbage(store: Store, older_than: str = "1d", dry_run: bool = False) -> list[str]:
    """Delete data that no commit names and in which nothing has changed for a time: what writers left that ended before their commit. The paths.

    Each name's folder is listed by one call and what the log names is taken away by a join;
    only folders that are left are looked into, whose newest file tells whether a writer is
    still at it. States of the log before the newest are garbage alike.
    """
    store.log.replay()
    files, limit = store.files, duration(older_than).total_seconds()
    found = [f"data/{name}/{x}" for name in files.names(files.path("data")) for x in files.names(files.path("data", name))]
    found += [f"artifacts/{x}" for x in files.names(files.path("artifacts"))]
    path = F.coalesce(F.get_json_object("row", "$.pack"), F.get_json_object("row", "$.path")).alias("path")
    named = store.log.versions.frame(row=True).select(path).union(store.log._chunks.frame(row=True).select(path)).where("path is not null")
    going = [r.path for r in store.spark.createDataFrame([(p,) for p in found], "path string").join(named, "path", "left_anti").toLocalIterator()]
    going += [f"_log/{x}" for x in store.log.old_states()]
    going = sorted(p for p in going if files.quiet(files.path(p)) >= limit)
    if not dry_run:
        _delete(store, going)
    return going


def drop(store: Store, name: str, force: bool = False) -> None:
    """Remove a name: its versions or its chunks and its table's row, in one commit."""
    going: list[dict] = []

    def build() -> list[dict]:
        shape = store.log.shape(name)
        if shape is None:
            raise StoreError(f"nothing is stored as {name}")
        if shape == "append":
            going[:] = store.log.chunks_of(name)
            if not force and any(c["variant_label"] for c in going):
                raise StoreError(f"labelled runs have appended to {name}; force=True drops it all the same")
            return [*[{"do": "chunk_delete", "path": c["path"]} for c in going], {"do": "table_delete", "name": name}]
        going[:] = store.log.of_name(name, rebinds=True)
        written = written_by_runs(store).join(store.log.runs.frame().where("status <> 'interactive'").select("run_id"), "run_id", "left_semi")
        if not force and not written.where(F.col("name") == name).isEmpty():
            raise StoreError(f"runs have written {name}; force=True drops it all the same")
        return [{"do": "version_delete", "name": name, "hash": v["content_hash"]} for v in going]

    store.log.commit(build)
    for v in going:
        store._live_views.pop((name, v.get("content_hash")), None)
    if store._published.pop(name, None):
        warnings.warn(f"the published view of {name} shows what was dropped", stacklevel=4)
    _delete(store, (r["path"] for r in going if r.get("path")))


def prune_variants(store: Store, script: str, label: str | None = None, dry_run: bool = False) -> list[str]:
    """Delete the run rows of a step's labels, or of one label. Their ids."""
    store.log.replay()
    ids: list[str] = []

    def build() -> list[dict]:
        ids[:] = [r["run_id"] for r in store.log.runs.values() if r["step"] == script and r["variant_label"] is not None and label in (None, r["variant_label"])]
        return [{"do": "run_delete", "run_id": i} for i in ids]

    build() if dry_run else store.log.commit(build)
    return ids
