"""The store: values under names, each write a version or a chunk, each read recorded in a running step."""

from __future__ import annotations

import base64
import inspect
import re
import textwrap
import uuid
import warnings
from collections.abc import Callable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as metadata
from .context import CURRENT
from .fs import Files
from .functions.hashing import md5, table_digest
from .log import RUN_FIELDS, Log, stamp
from .lookups import Lookups
from .names import LABEL_COLUMN, RUN_COLUMN, Options, StoreError, quoted, store_root, valid_label, valid_name
from .operators.drift import announce, exact_case, fitted, healed, no_like_columns, no_reserved_columns, opened, reconcile
from .operators.sampling import seeded_sample
from .refs import File, Sql
from .sources import artifacts
from .sources.files import file_digest, read_file

SHAPES = ("versioned", "append", "view")


class Store(Lookups):
    """A folder of tables, views and objects with their history.

    ``data/<name>/v=<hash16>`` is a version of a table, ``data/<name>/chunk=<id>`` what one
    write added to an append table, ``artifacts/`` has large objects and ``_log`` the commits.
    No path is ever written twice, so open DataFrames keep reading what they were made from.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, clock: Callable[[], datetime] | None = None, **options):
        self.spark = spark
        self.options = Options(**options)
        self.files = Files(spark, root or store_root(spark, self.options.project_stop_at))
        self.log = Log(self.files)
        self._clock = clock or (lambda: datetime.now(UTC).replace(tzinfo=None))
        self._live_views: dict[tuple[str, str], DataFrame] = {}
        self._published: dict[str, str] = {}
        self._manifests: dict[str, dict] = {}
        self.log.replay()

    def now(self) -> str:
        return stamp(self._clock())

    # --- writing -------------------------------------------------------------------------

    def stow(self, value, name: str, shape: str | None = None, label: str | None = None):
        """Write a value under a name and return it.

        A File is read into a new version of a table. A DataFrame or pandas frame is appended,
        or with shape "versioned" becomes a version. Shape "view" takes a Sql body, a function
        of the store that returns a DataFrame, or a DataFrame (a view of this session only).
        Anything else is kept as an object.
        """
        if not isinstance(name, str) and isinstance(value, str):
            raise StoreError("stow(value, name): the value comes first")
        valid_name(name)
        label = valid_label(label)
        if shape is not None and shape not in SHAPES:
            raise StoreError(f"shape is one of {', '.join(SHAPES)}")
        if isinstance(value, File):
            if shape:
                raise StoreError("a file has no shape to choose")
            self._stow_file(value.path, name, label)
        elif shape == "view":
            self._stow_view(value, name, label)
        elif isinstance(value, (DataFrame, pd.DataFrame)):
            df = self._frame(value)
            self._stow_table(df, name, label=label) if shape == "versioned" else self._append(df, name, label)
        elif shape == "append":
            raise StoreError("only frames can be appended")
        else:
            self._stow_artifact(value, name, label=label)
        return value

    def ingest(self, name: str, source: str):
        warnings.warn("ingest() is old: stow(File(source), name)", DeprecationWarning, stacklevel=2)
        return self.stow(File(source), name)

    def _frame(self, value) -> DataFrame:
        if isinstance(value, DataFrame):
            if value.sparkSession.sparkContext is not self.spark.sparkContext:
                raise StoreError("this DataFrame belongs to another Spark")
            return value
        if not isinstance(value.index, pd.RangeIndex):
            warnings.warn("the index is dropped; make it a column to keep it", stacklevel=3)
        return self.spark.createDataFrame(value.reset_index(drop=True))

    def _guard(self, name: str, shape: str, kind: str | None = None) -> None:
        """A name keeps its shape, and a versioned name its kind."""
        held = self.log.shape(name)
        if held and held != shape:
            raise StoreError(f"{name} is {held}, so nothing {shape} can be written there")
        kinds = {v["kind"] for v in self.log.of_name(name, rebinds=True)}
        if kind and kinds - {kind}:
            raise StoreError(f"{name} holds a {kinds.pop()}, so no {kind} can be written there")

    def _staged(self, df: DataFrame, name: str) -> tuple[str, str, int]:
        """Write rows to a fresh place: (path, digest, rows). The digest is of what was written, so the plan runs once."""
        path = self.files.path("data", name, f"staging-{uuid.uuid4().hex}")
        df.write.parquet(path)
        try:
            digest, n = table_digest(self.spark.read.schema(opened(df.schema)).parquet(path))
        except BaseException:
            self.files.delete(path)
            raise
        return path, digest, n

    def _stow_table(self, df: DataFrame, name: str, is_rebind: bool = False, label: str | None = None, source: dict | None = None, record: bool = True) -> str:
        self._guard(name, "versioned", "table")
        df = _typed(df)
        path, digest, _ = self._staged(df, name)
        # The staging place is new and holds this content for good: it need not be moved, only named by the commit.
        extra = {"schema": opened(df.schema).json(), "path": path.removeprefix(self.files.root + "/"), "size_bytes": self.files.size(path)} | (source or {})
        self._commit_version(name, digest, "table", extra, is_rebind, label, record)
        return digest

    def _commit_version(self, name: str, digest: str, kind: str, extra: dict, is_rebind: bool, label: str | None, record: bool) -> None:
        at = self.now()
        recorded = self._recorded({"name": name, "hash": digest}, label, at) if record else []
        known = None

        def build() -> list[dict]:
            nonlocal known
            self._still_ours()
            self._guard(name, "versioned", kind)
            known = self.log.versions.get((name, digest))
            if known:
                changes = {k: extra[k] for k in ("source_uri", "source_hash", "source_sql") if k in extra}
                if known.get("is_rebind") and not is_rebind:
                    changes |= {"is_rebind": False}
                return [{"do": "version_touch", "name": name, "hash": digest, "at": at, "set": changes}, *recorded]
            version = {"logical_name": name, "content_hash": digest, "physical_name": f"{name}__{digest[:16]}", "kind": kind, "first_seen": at, "last_seen": at, "is_rebind": is_rebind, "storage_location": kind}
            return [{"do": "version_add", "version": version | extra}, *recorded]

        try:
            self.log.commit(build)
        except BaseException:
            self._unstage(extra)
            raise
        if known:
            self._unstage(extra)
        self._refresh(name)
        n = len(self.log.of_name(name))
        if not known and n > self.options.version_warn:
            warnings.warn(f"{name} has {n} versions; prune() removes old ones", stacklevel=4)

    def _still_ours(self) -> None:
        """A picked-up run whose lease another process has taken over writes nothing more."""
        run = CURRENT.get()
        if run and run.lease and self.log.runs.get(run.run_id, {}).get("lease", run.lease) != run.lease:
            raise StoreError(f"{run.run_id} has been taken over by another process")

    def _unstage(self, row: dict) -> None:
        """Delete data that no commit names."""
        if row.get("path"):
            self.files.delete(self.files.path(row["path"]))

    def _recorded(self, output: dict, label: str | None, at: str) -> list[dict]:
        """The output goes to the running step; outside one it is a run of its own."""
        run = CURRENT.get()
        if run:
            run.wrote(output)
            return []
        row = {"step": f"<interactive:{at}>", "run_id": output.get("run_id") or new_id("run", at), "inputs": [], "outputs": [{k: v for k, v in output.items() if k != "run_id"}], "started_at": at, "duration_ms": 0, "status": "interactive", "variant_label": label, "helpers": [], "rebinds": []}
        return [{"do": "run_add", "run": row}]

    def _stow_file(self, path: str, name: str, label: str | None = None) -> str:
        digest = file_digest(self.spark, path)
        return self._stow_table(read_file(self.spark, path), name, label=label, source={"source_uri": path, "source_hash": digest})

    def _stow_artifact(self, value, name: str, is_rebind: bool = False, label: str | None = None, record: bool = True) -> str:
        self._guard(name, "versioned", "artifact")
        data = artifacts.dumps(value)
        digest = md5(data)
        extra: dict = {"size_bytes": len(data)}
        if len(data) < self.options.blob_threshold:
            extra |= {"payload": base64.b64encode(data).decode(), "storage_location": "blob"}
        else:
            path = f"artifacts/{name}__{digest[:16]}-{uuid.uuid4().hex[:8]}.bin"
            self.files.create(self.files.path(path), data)
            extra |= {"path": path, "storage_location": "file"}
        self._commit_version(name, digest, "artifact", extra, is_rebind, label, record)
        return digest

    def _append(self, df: DataFrame, name: str, label: str | None = None) -> None:
        self._guard(name, "append")
        no_reserved_columns(df)
        exact = exact_case(df)
        no_like_columns(df.schema, exact)
        run = CURRENT.get()
        label = run.label if run else label
        at = self.now()
        run_id = run.run_id if run else new_id("run", at)
        df = _typed(df)
        table = self.log.tables.get(name)
        coming = opened(df.schema)
        before = table["schema"] if table else None
        if table:
            drift = reconcile(T.StructType.fromJson(_json(table["schema"])), coming, self.options.widen_numbers, exact)
            announce(name, drift)
            target = drift.schema
        else:
            target = coming
        plan = df._jdf.queryExecution().logical().toString()
        path = self.files.path("data", name, f"chunk={uuid.uuid4().hex}")
        ours = {c if exact else c.lower() for c in df.columns}
        part = fitted(df, T.StructType([f for f in target if (f.name if exact else f.name.lower()) in ours]))
        part.withColumn(RUN_COLUMN, F.lit(run_id)).withColumn(LABEL_COLUMN, F.lit(label).cast("string")).write.parquet(path)
        held = opened(part.schema)
        digest, n = table_digest(self.spark.read.schema(held).parquet(path))
        chunk = {"logical_name": name, "run_id": run_id, "chunk_hash": digest, "rows_appended": n, "started_at": at, "variant_label": label, "path": path.removeprefix(self.files.root + "/"), "schema": held.json(), "size_bytes": self.files.size(path), "source_plan": plan}
        entry = {"kind": "append_table", "logical_name": name, "rows_appended": n, "chunk_hash": digest}
        recorded = self._recorded(entry if run else entry | {"run_id": run_id}, label, at)

        def build() -> list[dict]:
            """The chunk has a schema of its own and is fitted when read, so a table that another writer has changed takes it as it is."""
            self._still_ours()
            self._guard(name, "append")
            now = self.log.tables.get(name)
            if not now:
                first = [{"do": "table_add", "table": {"logical_name": name, "physical_name": f"{name}__append", "schema": target.json(), "first_seen": at, "last_seen": at, "row_count": 0, "size_bytes": 0}}]
            else:
                whole = target.json() if now["schema"] == before else reconcile(T.StructType.fromJson(_json(now["schema"])), coming, self.options.widen_numbers, exact).schema.json()
                first = [{"do": "table_schema", "name": name, "schema": whole}] if whole != now["schema"] else []
            return [*first, {"do": "chunk_add", "chunk": chunk}, *recorded]

        try:
            self.log.commit(build)
        except BaseException:
            self._unstage(chunk)
            raise
        self._refresh(name)

    def _stow_view(self, value, name: str, label: str | None = None, record: bool = True) -> str:
        """A stored query. Its identity is its text and what its inputs were bound to; it must read at least one name of the store."""
        from . import sqlstep

        self._guard(name, "versioned", "view")
        if isinstance(value, Sql):
            body = sqlstep.parse(value.value).body
            bound = sqlstep.bind(self, sqlstep.named_in(self, body))
            extra = {"source_sql": body, "bindings": [b.record() for b in bound.values()]}
            digest = md5(body + "\n" + "\n".join(sorted(f"{b.name}={b.hash}" for b in bound.values())))
            sqlstep.frame_of(self, body, bound)
        elif callable(value) and not isinstance(value, DataFrame):
            text = source_of(value)
            seen = _Watched(self)
            df = value(seen)
            if not isinstance(df, DataFrame):
                raise StoreError("a view's function returns a DataFrame")
            bound = seen.bound
            digest = md5(text + "\n" + "\n".join(sorted(f"{b.name}={b.hash}" for b in bound.values())))
            extra = {"source_sql": text, "bindings": [b.record() for b in bound.values()], "pickled": base64.b64encode(_pickle_function(value)).decode()}
            self._live_views[name, digest] = df
        elif isinstance(value, DataFrame):
            bound = {n: None for n in self.inputs_of(value)}
            text = _stable_plan(value)
            digest = md5(text)
            extra = {"source_sql": text, "bindings": [], "storage_location": "session"}
            self._live_views[name, digest] = value
        else:
            raise StoreError("a view is a Sql body, a function or a DataFrame")
        if not bound:
            raise StoreError("a view reads at least one name of the store")
        run = CURRENT.get()
        if run:
            for b in bound.values():
                if b:
                    run.read(b.name, b.hash)
        self._commit_version(name, digest, "view", extra, False, label, record)
        return digest

    def inputs_of(self, df: DataFrame) -> dict[str, str]:
        """Names of the store that a DataFrame reads files of, with the hash of the version or chunk."""
        below = self.files.path("data") + "/"
        folders = {p.partition("/data/")[2].rpartition("/")[0] for p in df.inputFiles() if below.partition(":")[2].lstrip("/") in p}
        out = {}
        for name in {f.partition("/")[0] for f in folders}:
            out |= {name: v["content_hash"] for v in self.log.of_name(name, rebinds=True) if v["kind"] == "table" and v["path"].removeprefix("data/") in folders}
            out |= {name: c["chunk_hash"] for c in self.log.chunks_of(name) if (c.get("pack") or c["path"]).removeprefix("data/") in folders}
        return out

    # --- reading -------------------------------------------------------------------------

    def grab(self, name: str, version: str | None = None, from_run: str | None = None, as_of=None, source: str | None = None, variant: str | None = None, run: str | None = None, between: dict | None = None):
        """Read a name: its newest value, or the one that at most one selector asks for.

        Versioned: version (a hash), from_run, as_of, variant, run="all" (a dict of all, oldest
        first). Append: run or from_run, variant, run="all" (with run_id and variant_label);
        by default the running step's own rows, outside one those of the newest run. between
        takes only rows with values in ranges, {column: (low, high)}, and skips files of packs by them.
        source names a file to read first if the name is new or the file has changed.
        """
        valid_name(name)
        self.log.replay()
        chosen = [k for k, v in dict(version=version, from_run=from_run, as_of=as_of, variant=variant, run=run).items() if v is not None]
        if len(chosen) > 1:
            raise StoreError(f"choose one of {', '.join(chosen)}")
        if source is not None:
            held = self.log.of_name(name)
            if not held or held[-1].get("source_hash") != file_digest(self.spark, source):
                self._stow_file(source, name)
        shape = self.log.shape(name)
        if shape is None:
            raise StoreError(f"nothing is stored as {name}")
        if shape == "append":
            return self._grab_append(name, version, from_run or run, as_of, variant, between)
        if between:
            raise StoreError("between is for append tables")
        if run is not None:
            if run != "all":
                raise StoreError("of a versioned name, run is 'all'; from_run asks for one run's")
            self._read(name, None)
            return {v["content_hash"]: self.value_of(v) for v in self.log.of_name(name)}
        v = self.version_row(name, version, from_run, as_of, variant)
        self._read(name, v["content_hash"])
        return self.value_of(v)

    def _read(self, name: str, digest: str | None) -> None:
        run = CURRENT.get()
        if run:
            run.read(name, digest)

    def value_of(self, v: dict):
        """The table, view or object that a version row stands for."""
        if v["kind"] == "table":
            return self.spark.read.schema(T.StructType.fromJson(_json(v["schema"]))).parquet(self.files.path(v["path"]))
        if v["kind"] == "view":
            return self._view(v)
        if v.get("payload") is not None:
            return artifacts.loads(base64.b64decode(v["payload"]))
        if not v.get("path") or not self.files.exists(self.files.path(v["path"])):
            raise StoreError(f"the bytes of {v['physical_name']} are gone")
        return artifacts.loads(self.files.read(self.files.path(v["path"])))

    def _view(self, v: dict) -> DataFrame:
        from . import sqlstep

        key = (v["logical_name"], v["content_hash"])
        if v["storage_location"] == "session":
            if key not in self._live_views:
                raise StoreError(f"{v['physical_name']} was made from a DataFrame of another session; store Sql or a function")
            return self._live_views[key]
        bound = {b["name"]: sqlstep.binding_of(b) for b in v["bindings"]}
        if "pickled" in v:
            return _unpickle_function(base64.b64decode(v["pickled"]))(_Pinned(self, bound))
        return sqlstep.frame_of(self, v["source_sql"], bound)

    # append tables

    def _grab_append(self, name: str, version, run: str | None, as_of, variant: str | None, between: dict | None = None) -> DataFrame:
        if version is not None or as_of is not None:
            raise StoreError("an append table has runs: version and as_of are for versioned names")
        if run == "all":
            self._read(name, None)
            return self.append_rows(name, system=True, between=between)
        context = CURRENT.get()
        bound = context and context.bindings.get(name)
        if variant is not None:
            found = self.newest_append_run(name, variant)
            if not found:
                raise StoreError(f"no run labelled {variant} wrote {name}")
            run = found
        elif run is None and bound:
            run = bound.run_id
        if run is not None:
            self._read(name, self.chunk_hash(name, run))
            return self.append_rows(name, run, between=between)
        if context:
            newest = self.newest_append_run(name)
            self._read(name, self.chunk_hash(name, newest) if newest else None)
            return self.append_rows(name, context.run_id, between=between)
        newest = self.newest_append_run(name)
        return self.append_rows(name, newest or "", between=between)

    def append_rows(self, name: str, run_id: str | None = None, system: bool = False, between: dict | None = None) -> DataFrame:
        """The rows of a run (of all without one) under the table's present schema, with values in ranges.

        Only the folders of the chunks asked for are listed and read, and of packs the files
        that the manifest names for the run and the ranges; chunks of one schema are one scan
        however many they are.
        """
        out = self.chunk_rows(name, self.log.chunks_of(name, run_id), run_id, between)
        if system:
            return out.withColumnRenamed(RUN_COLUMN, "run_id").withColumnRenamed(LABEL_COLUMN, "variant_label")
        return out.drop(RUN_COLUMN, LABEL_COLUMN)

    def chunk_rows(self, name: str, chunks: list[dict], run_id: str | None = None, between: dict | None = None) -> DataFrame:
        """The rows of some chunks under the table's present schema, and the columns of their run and label."""
        from . import packs

        target = healed(T.StructType.fromJson(_json(self.log.tables[name]["schema"])), self.spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true")
        between = packs.checked(between, target.names)
        loose: dict[str, list[str]] = {}
        packed: dict[tuple[str, str], list[dict]] = {}
        for c in chunks:
            if c.get("pack"):
                packed.setdefault((c["pack"], c["schema"]), []).append(c)
            else:
                loose.setdefault(c["schema"], []).append(self.files.path(c["path"]))
        marks = [T.StructField(RUN_COLUMN, T.StringType()), T.StructField(LABEL_COLUMN, T.StringType())]
        held = lambda schema: T.StructType([*T.StructType.fromJson(_json(schema)).fields, *marks])
        parts = [self.spark.read.schema(held(schema)).parquet(*paths) for schema, paths in loose.items()]
        parts += [packs.packed_rows(self, pack, mine, held(schema), run_id, between) for (pack, schema), mine in packed.items()]
        whole, out = T.StructType([*target.fields, *marks]), None
        for part in parts:
            if part is not None:
                out = fitted(part, whole) if out is None else out.unionByName(fitted(part, whole))
        return self.spark.createDataFrame([], whole) if out is None else packs.in_ranges(out, between)

    def manifest(self, pack: str) -> dict:
        """What the files of a pack hold."""
        from .packs import MANIFEST

        if pack not in self._manifests:
            self._manifests[pack] = _json(self.files.read(self.files.path(pack, MANIFEST)).decode())
        return self._manifests[pack]

    def compact(self, name: str, **options) -> int:
        from .packs import compact

        return compact(self, name, **options)

    # --- SQL and metadata ----------------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the newest value of every table and view named in it, and over _tr_runs, _tr_versions, _tr_append_tables and _tr_append_chunks."""
        self.log.replay()
        session = self.spark.newSession()
        words = set(re.findall(r"\w+", text))
        for name in self.log.known(words):
            df = self.latest(name)
            if df is not None:
                df.createOrReplaceTempView(name) if session is self.spark else _view_in(session, name, df)
        about = {"_tr_runs": self.runs, "_tr_versions": self.version_table, "_tr_append_tables": self.table_registry, "_tr_append_chunks": self.chunk_table}
        for name in words & set(about):
            _view_in(session, name, about[name]())
        return session.sql(text)

    def latest(self, name: str) -> DataFrame | None:
        """The newest table or view of a name that is no rebind; of an append table all rows with its system columns."""
        if name in self.log.tables:
            return self.append_rows(name, system=True)
        rows = [v for v in self.log.of_name(name) if v["kind"] != "artifact"]
        return self.value_of(rows[-1]) if rows else None

    def publish(self, *names: str, prefix: str = "") -> list[str]:
        """Temp views of the session for the newest value of names (of all tables and views without any), for any SQL client of it; the views' names.

        They are made anew when this store commits something under their names; what other
        processes have committed shows when they are published again.
        """
        self.log.replay()
        made = []
        for name in names or sorted(self.log.known()):
            df = self.latest(name)
            if df is not None:  # else it is an object
                _view_in(self.spark, prefix + name, df)
                self._published[name] = prefix + name
                made.append(prefix + name)
        return made

    def _refresh(self, name: str) -> None:
        """A published view shows what has just been committed under its name."""
        if name in self._published:
            _view_in(self.spark, self._published[name], self.latest(name))

    def exists(self, name: str) -> bool:
        """Whether anything is stored under a name, versions that were only bound for a run included."""
        self.log.replay()
        return self.log.shape(valid_name(name)) is not None

    def drop(self, name: str, force: bool = False) -> None:
        """Remove a name with all its versions or chunks, so that it is free for any shape. What runs have written, or labelled runs have appended, stays in place and is refused unless force is set. The runs' rows stay."""
        from .gc import drop

        drop(self, valid_name(name), force)

    def run_view(self, name: str, run_id: str) -> str:
        """A temp view of one run's rows of an append table; its name."""
        view = f"{name}__run__{run_id}"
        self.append_rows(name, run_id).createOrReplaceTempView(view)
        return view

    def sample(self, df: DataFrame, n: int, key: list[str] | None = None) -> DataFrame:
        """n rows by the running step's seed (0 without one), the same on every run."""
        run = CURRENT.get()
        return seeded_sample(df, n, (run.seed if run and run.seed is not None else 0.0), key)

    def runs(self) -> DataFrame:
        self.log.replay()
        return self.log.runs.frame().select(*RUN_FIELDS)

    def version_table(self) -> DataFrame:
        return self.log.versions.frame().select(*metadata.VERSIONS)

    def table_registry(self) -> DataFrame:
        return metadata.frame(self.spark, list(self.log.tables.values()), metadata.TABLES)

    def chunk_table(self) -> DataFrame:
        return self.log.chunk_frame().select(*metadata.CHUNKS)

    # --- steps, sweeps, queue, listings and pruning live in modules of their own -----------

    def launch(self, code, **options):
        from .steps import launch

        return launch(self, code, **options)

    def queue(self, code, **options):
        from .queue import queue

        return queue(self, code, **options)

    def discard_queued(self, **options):
        from .queue import discard_queued

        return discard_queued(self, **options)

    def launch_code(self, run_id: str, from_db: bool = False):
        from .steps import launch_code

        return launch_code(self, run_id, from_db)

    def is_stale(self, what) -> tuple[bool, list[str]]:
        from .staleness import is_stale

        return is_stale(self, what)

    def versions(self, name: str, include_rebinds: bool = True) -> DataFrame:
        from .listing import versions

        return versions(self, name, include_rebinds)

    def variants(self, script: str | None = None, name: str | None = None) -> DataFrame:
        from .listing import variants

        return variants(self, script, name)

    def variants_unexplored(self, script: str) -> DataFrame:
        from .listing import variants_unexplored

        return variants_unexplored(self, script)

    def prune(self, name: str | None = None, **options):
        from .gc import prune

        return prune(self, name, **options)

    def collect_garbage(self, older_than: str = "1d", dry_run: bool = False) -> list[str]:
        from .gc import collect_garbage

        return collect_garbage(self, older_than, dry_run)

    def prune_variants(self, script: str, label: str | None = None, dry_run: bool = False) -> list[str]:
        from .gc import prune_variants

        return prune_variants(self, script, label, dry_run)


class _Watched:
    """The store as a view's function sees it: grab() also notes what names are bound to."""

    def __init__(self, store: Store):
        self.store, self.spark, self.bound = store, store.spark, {}

    def grab(self, name: str) -> DataFrame:
        from . import sqlstep

        self.bound[name] = sqlstep.bind(self.store, [name])[name]
        return sqlstep.rows_of(self.store, self.bound[name])


class _Pinned:
    """The store as a stored view's function sees it: names are what they were when it was stored."""

    def __init__(self, store: Store, bound: dict):
        self.store, self.spark, self.bound = store, store.spark, bound

    def grab(self, name: str) -> DataFrame:
        from . import sqlstep

        return sqlstep.rows_of(self.store, self.bound[name])


def new_id(kind: str, at: str) -> str:
    t = datetime.fromisoformat(at)
    return f"{kind}_{t:%Y%m%d_%H%M%S}{t.microsecond // 1000:03d}_{uuid.uuid4().hex[:6]}"


def source_of(function: Callable, code: str | None = None) -> str:
    """The text of a function; where Python can't find it, the text given as code."""
    if code:
        return code
    try:
        return textwrap.dedent(inspect.getsource(function))
    except (OSError, TypeError):
        raise StoreError("the source of this function can't be read here; pass it as code=") from None


def _pickle_function(f: Callable) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps(f)


def _unpickle_function(data: bytes) -> Callable:
    from pyspark import cloudpickle

    return cloudpickle.loads(data)


def _json(text: str) -> dict:
    import json

    return json.loads(text)


def _typed(df: DataFrame) -> DataFrame:
    """Columns that are null throughout as text: files have no such type, at whatever depth."""
    wanted = _no_nulls(df.schema)
    return df if wanted == df.schema else df.select(*[df[quoted(f.name)].cast(w.dataType).alias(f.name) if f.dataType != w.dataType else df[quoted(f.name)] for f, w in zip(df.schema, wanted, strict=True)])


def _no_nulls(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _no_nulls(f.dataType), f.nullable, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_no_nulls(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_no_nulls(kind.keyType), _no_nulls(kind.valueType), kind.valueContainsNull)
    return kind


def _stable_plan(df: DataFrame) -> str:
    """The analyzed plan with its expression ids numbered in order of appearance."""
    seen: dict[str, str] = {}
    return re.sub(r"#\d+L?", lambda m: seen.setdefault(m[0], f"#{len(seen)}"), df._jdf.queryExecution().analyzed().toString())


def _view_in(session: SparkSession, name: str, df: DataFrame) -> None:
    """A temp view of a DataFrame in another session of the same Spark."""
    jvm_df = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
    DataFrame(jvm_df, session).createOrReplaceTempView(name)
