"""The store as a Spark data source: spark.read.format("tallyrun").options(store=..., table=..., version=...).load().

It needs no session of the store's own: a client of Spark that knows the folder reads what
was committed last when it calls load(). It is Python; grab() and the views that publish()
makes read the same files by Spark's own reader, prune columns and push filters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..log import Log
from ..log_state import Rows, RunFilter
from ..lookups import Lookups
from ..names import LABEL_COLUMN, RUN_COLUMN, StoreError
from ..operators.drift import healed

#: Options that choose a value, as the arguments of grab() do.
SELECTORS = ("version", "from_run", "as_of", "variant", "run")
BATCH = 10_000


class ArrowFiles:
    """What the log needs of a file system, where there is no JVM."""

    def __init__(self, root: str):
        self.fs, place = pyarrow.fs.FileSystem.from_uri(root if ":" in root else "file://" + root)
        self.root = place.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound

    def names(self, path: str) -> list[str]:
        return sorted(f.base_name for f in self.fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)))

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path) as f:
            return f.read()


class ArrowRows(Rows):
    """Rows of a written state read without Spark."""

    def _texts(self, among: dict[str, list]) -> Iterator[str]:
        files = f"{self.base}/{self.kind}"
        condition = None
        for column, values in among.items():
            one = pads.field(column).isin(values)
            condition = one if condition is None else condition & one
        for batch in pads.dataset(files, filesystem=self.files.fs, format="parquet").to_batches(columns=["row"], filter=condition):
            yield from batch.column("row").to_pylist()

    def _texts_of(self, keys: list[tuple]) -> Iterator[str]:
        return self._texts({column: sorted({k[place] for k in keys}) for place, column in enumerate(self.key)})

    def _best(self, wanted: RunFilter) -> str | None:
        among = {c: [v] for c, v in (("step", wanted.step), ("variant_label", wanted.label), ("status", wanted.status)) if v is not None}
        if wanted.ids is not None:
            among["run_id"] = sorted(wanted.ids)
        rows = ((json.loads(t), t) for t in self._texts(among))
        found = (x for x in rows if self.key_of(x[0]) not in self._changed and wanted.takes(x[0]))
        return max(found, key=lambda x: (x[0]["started_at"], x[0]["seq"]), default=(None, None))[1]


def root_of(options: dict[str, str]) -> str | None:
    return options.get("store") or options.get("path")


class Found(Lookups):
    """What the options of a read stand for now: a schema, and files with the schema that each was written under."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        if not root_of(options) or not options.get("table"):
            raise StoreError("name the store's folder as store and what to read as table")
        chosen = {k: options[k] for k in SELECTORS if options.get(k)}
        if len(chosen) > 1:
            raise StoreError(f"choose one of {', '.join(chosen)}")
        self.files, name = ArrowFiles(root_of(options)), options["table"]
        self.log = Log(self.files, ArrowRows)
        self.log.replay()
        self.runs: set[str] = set()
        shape = self.log.shape(name)
        if shape is None:
            raise StoreError(f"nothing is stored as {name}")
        (self._append if shape == "append" else self._versioned)(name, **chosen)

    def _versioned(self, name: str, **chosen) -> None:
        if "run" in chosen:
            raise StoreError(f"{name} is versioned: from_run asks for what a run wrote")
        v = self.version_row(name, **chosen)
        if v["kind"] != "table":
            raise StoreError(f"{name} holds a {v['kind']}; the data source reads tables")
        self.schema = T.StructType.fromJson(json.loads(v["schema"]))
        self.parts = [(v["path"], v["schema"])]

    def _append(self, name: str, run: str | None = None, from_run: str | None = None, variant: str | None = None, **others) -> None:
        if others:
            raise StoreError("an append table has runs: version and as_of are for versioned names")
        run = from_run or run
        if variant:
            run = self.newest_append_run(name, variant)
            if not run:
                raise StoreError(f"no run labelled {variant} wrote {name}")
        run = run or self.newest_append_run(name) or ""
        self.schema = healed(T.StructType.fromJson(json.loads(self.log.tables[name]["schema"])))
        if run == "all":
            self.schema = T.StructType([*self.schema.fields, T.StructField("run_id", T.StringType()), T.StructField("variant_label", T.StringType())])
        chunks = self.log.chunks_of(name, None if run == "all" else run)
        self.parts = list(dict.fromkeys((c.get("pack") or c["path"], c["schema"]) for c in chunks))
        self.runs = {c["run_id"] for c in chunks if c.get("pack")}

    def files_of(self) -> list[OneFile]:
        runs = tuple(sorted(self.runs))
        return [OneFile(f"{path}/{x}", held, runs if "/pack=" in path else ()) for path, held in self.parts for x in self.files.names(self.files.path(path)) if x.endswith(".parquet")]


@dataclass
class OneFile(InputPartition):
    path: str
    held: str
    runs: tuple[str, ...] = ()  # of a pack: those whose rows are wanted


class StoreSource(DataSource):
    """Options: store (or path) and table, and one of version, from_run, as_of, variant and run ("all" adds run_id and variant_label).

    Filters are not pushed: Spark (4.1) keeps a Python reader with the filters of one query and
    gives it to later ones over the same relation that push none, which then miss rows.
    """

    @classmethod
    def name(cls) -> str:
        return "tallyrun"

    def schema(self) -> T.StructType:
        return Found(self.options).schema

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(self.options, schema)


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.wanted = dict(options), schema

    def partitions(self) -> list[OneFile]:
        return Found(self.options).files_of() or [OneFile("", "")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.wanted)
        if not partition.path:
            return
        files = ArrowFiles(root_of(self.options))
        data = pads.dataset(files.path(partition.path), filesystem=files.fs, format="parquet")
        held = {f.name.lower(): f.name for f in data.schema}
        marks = {"run_id": RUN_COLUMN, "variant_label": LABEL_COLUMN}
        source = {f.name: held.get(f.name.lower()) or (held.get(marks[f.name]) if f.name in marks else None) for f in target}
        own = {f.name.lower(): f.dataType for f in healed(T.StructType.fromJson(json.loads(partition.held)))}
        for f in self.wanted:
            if f.name.lower() in own and own[f.name.lower()] != f.dataType:
                raise StoreError(f"column {f.name} has another type in earlier chunks; read the table with grab()")
        wanted = pads.field(RUN_COLUMN).isin(list(partition.runs)) if partition.runs else None
        for batch in data.to_batches(columns=[c for c in source.values() if c], filter=wanted, batch_size=BATCH):
            columns = [pa.nulls(batch.num_rows, f.type) if source[f.name] is None else batch.column(source[f.name]).cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target)
