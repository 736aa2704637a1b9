"""The rows of a store's state: in memory, or lying in Parquet and read as they are asked for."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as metadata
from .context import output_matches
from .fs import Files
from .operators.drift import healed

#: Of each kind of rows: what tells them apart, the columns of its table, and what its files are sorted by.
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "runs": (("run_id",), metadata.RUNS, ("step", "run_id")),
    "versions": (("logical_name", "content_hash"), metadata.VERSIONS, ("logical_name", "first_seen")),
    "chunks": (("path",), (*metadata.CHUNKS, "path"), ("logical_name", "run_id")),
}
#: Rows of a file of the written state, and keys that are looked up in it by one filter.
FILE_ROWS, FILTER_KEYS = 200_000, 1_000


def healed_row(row: dict) -> dict:
    """A row as this format has it: the recorded schema, if there is one, is nullable at every depth."""
    if row.get("schema"):
        row["schema"] = healed(T.StructType.fromJson(json.loads(row["schema"])), exact_case=True).json()
    return row


@dataclass(frozen=True)
class RunFilter:
    """What a run that is looked for is like. output: its name and, of versions and chunks, the hash (None for any)."""

    ids: frozenset[str] | set[str] | None = None
    step: str | None = None
    label: str | None = None
    status: str | None = None
    not_status: tuple[str, ...] = ()
    output: tuple[str, str | None] | None = None
    until: str | None = None

    def takes(self, r: dict) -> bool:
        return (
            bool(r["started_at"])
            and (self.ids is None or r["run_id"] in self.ids)
            and self.step in (None, r["step"])
            and self.label in (None, r["variant_label"])
            and self.status in (None, r["status"])
            and r["status"] not in self.not_status
            and (self.until is None or r["started_at"] <= self.until)
            and (self.output is None or any(output_matches(o, *self.output) for o in r["outputs"] or ()))
        )

    def column(self) -> F.Column:
        out = F.col("started_at").isNotNull()
        if self.ids is not None:
            out = out & F.col("run_id").isin(*self.ids)
        for column, value in (("step", self.step), ("variant_label", self.label), ("status", self.status)):
            if value is not None:
                out = out & (F.col(column) == value)
        if self.not_status:
            out = out & ~F.col("status").isin(*self.not_status)
        if self.until is not None:
            out = out & (F.col("started_at") <= F.lit(self.until).cast("timestamp_ntz"))
        if self.output is not None:
            name, digest = self.output
            out = out & F.exists("outputs", lambda o: (o["name"] == name) & (F.lit(True) if digest is None else o["hash"] == digest))
        return out


assert {f.name for f in fields(RunFilter)} == {"ids", "step", "label", "status", "not_status", "output", "until"}


class Rows(Mapping):
    """Rows by key. Without a written state all are in memory; with one, those that were looked up and those changed since."""

    def __init__(self, files: Files, kind: str):
        self.files, self.kind = files, kind
        self.key, self.columns, self.sorting = KINDS[kind]
        self.base: str | None = None
        self.held: dict = {}
        self.whole = True
        self._changed: set = set()
        self._asked: set[str] = set()
        self._named: dict[str, dict] = {}

    # one row

    def key_of(self, row: dict):
        return row[self.key[0]] if len(self.key) == 1 else tuple(row[k] for k in self.key)

    def _hold(self, row: dict) -> None:
        key = self.key_of(row)
        self.held[key] = row
        if "logical_name" in row:
            self._named.setdefault(row["logical_name"], {})[key] = None

    def put(self, row: dict) -> None:
        self._hold(row)
        self._changed.add(self.key_of(row))

    def drop(self, key) -> None:
        row = self.held.pop(key, None)
        if row and "logical_name" in row:
            self._named[row["logical_name"]].pop(key, None)
        self._changed.add(key)

    def __getitem__(self, key) -> dict:
        if key not in self.held and not self.whole and key not in self._changed:
            self.pull_keys([key])
        return self.held[key]

    def __contains__(self, key) -> bool:
        try:
            self[key]
        except KeyError:
            return False
        return True

    # all of them

    def load(self) -> None:
        if not self.whole:
            self._pull({})
            self.held = dict(sorted(self.held.items(), key=lambda kv: kv[1]["seq"]))
            self.whole = True

    def __iter__(self) -> Iterator:
        self.load()
        return iter(self.held)

    def __len__(self) -> int:
        self.load()
        return len(self.held)

    # what lies in the written state

    def _written(self, row: bool = False) -> DataFrame:
        kinds = metadata.schema((*self.columns, "seq", *(("row",) if row else ())))
        return self.files.spark.read.schema(kinds).parquet(f"{self.base}/{self.kind}")

    def _texts(self, among: dict[str, list]) -> Iterator[str]:
        """Of written rows whose columns have one of the given values each."""
        found = self._written(row=True)
        for column, values in among.items():
            found = found.where(F.col(column).isin(*values))
        return (text for (text,) in found.select("row").toLocalIterator())

    def _pull(self, among: dict[str, list]) -> None:
        self._take_in(self._texts(among))

    def _take_in(self, texts: Iterator[str]) -> None:
        for text in texts:
            row = json.loads(text)
            key = self.key_of(row)
            if key not in self.held and key not in self._changed:
                self._hold(row)

    def pull_keys(self, keys: list) -> None:
        if self.whole:
            return
        keys = [k for k in dict.fromkeys(keys) if k not in self.held and k not in self._changed and repr(k) not in self._asked]
        if keys:
            self._take_in(self._texts_of([(k,) for k in keys] if len(self.key) == 1 else keys))
            self._asked.update(map(repr, keys))

    def _texts_of(self, keys: list[tuple]) -> Iterator[str]:
        """Of written rows with given keys: by a filter, or for many by a join."""
        if len(keys) <= FILTER_KEYS:
            return self._texts({column: sorted({k[place] for k in keys}) for place, column in enumerate(self.key)})
        return (text for (text,) in self._written(row=True).join(self._frame_of(keys), list(self.key), "left_semi").select("row").toLocalIterator())

    def _frame_of(self, keys: list[tuple]) -> DataFrame:
        return self.files.spark.createDataFrame(keys, T.StructType([T.StructField(k, T.StringType()) for k in self.key]))

    def of_name(self, name: str) -> list[dict]:
        if not self.whole and f"name {name}" not in self._asked:
            self._pull({"logical_name": [name]})
            self._asked.add(f"name {name}")
        return [self.held[k] for k in self._named.get(name, ())]

    def names(self, words: set[str] | None) -> set[str]:
        if not self.whole:
            if words is None:
                self.load()
            elif new := [w for w in words if f"name {w}" not in self._asked]:
                self._pull({"logical_name": new})
                self._asked.update(f"name {w}" for w in new)
        return {n for n, keys in self._named.items() if keys}

    def newest(self, wanted: RunFilter) -> dict | None:
        """Of runs: the last to start of those wanted. Of a written state only that one is read."""
        if not self.whole and wanted.ids is not None and len(wanted.ids) > FILTER_KEYS:
            self.load()
        rows = [r for r in self.held.values() if wanted.takes(r)]
        if not self.whole:
            best = self._best(wanted)
            if best:
                row = json.loads(best)
                self._hold(row)
                rows.append(row)
        return max(rows, key=lambda r: (r["started_at"], r["seq"]), default=None)

    def _best(self, wanted: RunFilter) -> str | None:
        """Of the written runs that have not changed and are wanted, the last to start."""
        best = self._unchanged(self._written(row=True).where(wanted.column())).orderBy(F.col("started_at").desc(), F.col("seq").desc()).select("row").first()
        return best and best[0]

    def _unchanged(self, df: DataFrame) -> DataFrame:
        if not self._changed:
            return df
        gone = self._frame_of([(k,) if len(self.key) == 1 else k for k in self._changed])
        return df.join(gone, list(self.key), "left_anti").select(*df.columns)

    def frame(self, row: bool = False) -> DataFrame:
        """All rows as a DataFrame (with their text in ``row``): the written state but for what has changed, and that. The driver holds no more than the changes."""
        if self.base is None:
            own = self.held.values()
        else:
            own = [self.held[k] for k in self._changed if k in self.held]
        columns = (*self.columns, "seq", *(("row",) if row else ()))
        here = metadata.frame(self.files.spark, [r | {"row": json.dumps(r)} for r in own] if row else own, columns)
        return here if self.base is None else self._unchanged(self._written(row)).unionByName(here)

    def write(self, folder: str) -> None:
        df = self.frame(row=True)
        parts = 1 + (len(self.held) if self.base is None else self._written().count() + len(self._changed)) // FILE_ROWS
        df.repartitionByRange(parts, *self.sorting).sortWithinPartitions(*self.sorting).write.parquet(f"{folder}/{self.kind}")

    def rest_on(self, folder: str, fresh: bool = False) -> None:
        """From now on the state in a folder is what rows have changed since."""
        self.base, self._changed = folder, set()
        if fresh:
            self.whole = False
