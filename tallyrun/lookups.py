"""Which version, run or chunk a read asks for: lookups in a store's log that need no Spark."""

from __future__ import annotations

from .context import CURRENT, output_matches
from .log import Log, stamp
from .names import StoreError
from .refs import moment


class Lookups:
    log: Log

    def version_row(self, name: str, version: str | None = None, from_run: str | None = None, as_of=None, variant: str | None = None) -> dict:
        bound = CURRENT.get() and CURRENT.get().bindings.get(name)
        if bound and not (version or from_run or as_of or variant):
            version = bound.hash
        if version is not None:
            if (name, version) not in self.log.versions:
                raise StoreError(f"{name} has no version {version}")
            return self.log.versions[name, version]
        if from_run is not None:
            if from_run not in self.log.runs:
                raise StoreError(f"there is no run {from_run}")
            return self._version_of_run(name, self.log.runs[from_run])
        if variant is not None:
            run = self.log.newest_run(label=variant, output=(name, None))
            if not run:
                raise StoreError(f"no run labelled {variant} wrote {name}")
            return self._version_of_run(name, run)
        rows = self.log.of_name(name)
        if as_of is not None:
            rows = [v for v in rows if v["first_seen"] <= stamp(moment(as_of))]
        if not rows:
            raise StoreError(f"{name} has no version" + (f" as of {as_of}" if as_of is not None else ""))
        return rows[-1]

    def _version_of_run(self, name: str, run: dict) -> dict:
        made = [o for o in run["outputs"] or () if output_matches(o, name)]
        if not made:
            raise StoreError(f"run {run['run_id']} did not write {name}")
        if (name, made[-1]["hash"]) not in self.log.versions:
            raise StoreError(f"what run {run['run_id']} wrote to {name} has been pruned")
        return self.log.versions[name, made[-1]["hash"]]

    def newest_append_run(self, name: str, label: str | None = None) -> str | None:
        """The run that started last among those with rows in a table (of a label)."""
        run = self.log.newest_run(ids={c["run_id"] for c in self.log.chunks_of(name)}, label=label)
        if run or label:
            return run["run_id"] if run else None
        chunks = self.log.chunks_of(name)  # written by a step that is still running
        return max(chunks, key=lambda c: c["seq"])["run_id"] if chunks else None

    def chunk_hash(self, name: str, run_id: str) -> str | None:
        """Of the last chunk that a run wrote to a table."""
        mine = self.log.chunks_of(name, run_id)
        return max(mine, key=lambda c: c["seq"])["chunk_hash"] if mine else None
