"""The commit log of a store: numbered files of actions, and the state they add up to.

A commit is one file, made only if no file has its number, so it is there as a whole or not
at all; of two writers one takes the number and the other replays and tries the next. Data
is written before the commit that names it and is garbage without it. Actions are made
from the state that they follow; one on something that is gone does nothing when replayed.

The state is written now and then, so that opening a store reads few commits. A short
history is one file and is held in memory. A longer one is Parquet (log_state.Rows): what
is looked up of it is read by name, id or label, and listings are plans over it.
"""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime

from . import schema as metadata
from .fs import Files
from .log_state import KINDS, RunFilter, Rows, healed_row
from .names import StoreError

RUN_FIELDS = metadata.RUNS


def stamp(t: datetime) -> str:
    return t.isoformat(timespec="microseconds")


#: Commits after which the state is written as a whole. A longer history is written after a tenth of its
#: commits, so that all snapshots together grow as it does, and after so many at most, which bounds what opening reads.
SNAPSHOT_EVERY, SNAPSHOT_AT_MOST = 100, 10_000
#: Rows up to which the state is one file and is held in memory.
WHOLE_ROWS = 20_000
#: Of the actions and the state; a store of a later one is not opened, one of an earlier one is brought up to it when it is read.
FORMAT = 2


class Log:
    def __init__(self, files: Files, rows: type[Rows] = Rows):
        self.files, self.folder, self.next, self.format = files, files.path("_log"), 0, 1
        self.runs, self.versions, self._chunks = (rows(files, kind) for kind in KINDS)
        self.tables: dict[str, dict] = {}
        self._lock = threading.RLock()

    @property
    def chunks(self) -> list[dict]:
        return list(self._chunks.values())

    def chunk_frame(self):
        return self._chunks.frame()

    def old_states(self) -> list[str]:
        """Folders of written states that a newer one has replaced; readers that opened before may still use them."""
        folders = [x for x in self.files.names(self.folder) if x.endswith(".state")]
        return [x for x in folders if x < (self.runs.base or "").rpartition("/")[2]]

    def _file(self, n: int) -> str:
        return f"{self.folder}/{n:020d}.json"

    def replay(self) -> None:
        """Take in the commits since the last look; at first from the newest snapshot on. Only the first look lists the folder."""
        with self._lock:
            if not self.next:
                for name in reversed([x for x in self.files.names(self.folder) if x.endswith(".snapshot")]):
                    self._restore(json.loads(self.files.read(f"{self.folder}/{name}")))
                    break
            found = []
            while self.files.exists(self._file(self.next + len(found))):
                found.append(json.loads(self.files.read(self._file(self.next + len(found)))))
            self._prepare(found)
            for actions in found:
                self._take(actions, self.next)
                self.next += 1

    def commit(self, build) -> None:
        """Write the next commit. build makes its actions, or raises, from the newest state: again each time another writer was first. None are no commit."""
        with self._lock:
            while True:
                self.replay()
                actions = build()
                if not actions:
                    return
                if not self.next or self.format < FORMAT:
                    actions = [{"do": "format", "format": FORMAT}, *actions]
                if self.files.create(self._file(self.next), json.dumps(actions).encode()):
                    self._prepare([actions])
                    self._take(actions, self.next)
                    self.next += 1
                    if self.next % min(SNAPSHOT_AT_MOST, SNAPSHOT_EVERY * max(1, self.next // (10 * SNAPSHOT_EVERY))) == 0:
                        self._snapshot()
                    return

    def _snapshot(self) -> None:
        """Write the state: one file, or for a long history Parquet from the last state and what has changed, merged by Spark."""
        name = f"{self.folder}/{self.next:020d}.snapshot"
        everything = (self.runs, self.versions, self._chunks)
        if all(rows.whole for rows in everything) and sum(map(len, everything)) <= WHOLE_ROWS:
            self.files.create(name, json.dumps(self._state()).encode())
            return
        folder = f"{self.next:020d}-{uuid.uuid4().hex[:8]}.state"
        for rows in everything:
            rows.write(f"{self.folder}/{folder}")
        if self.files.create(name, json.dumps({"format": FORMAT, "next": self.next, "tables": list(self.tables.values()), "state": folder}).encode()):
            for rows in everything:
                rows.rest_on(f"{self.folder}/{folder}")
        else:  # another writer's is there
            self.files.delete(f"{self.folder}/{folder}")

    def _state(self) -> dict:
        return {"format": FORMAT, "next": self.next, "runs": list(self.runs.values()), "versions": list(self.versions.values()), "tables": list(self.tables.values()), "chunks": self.chunks}

    def _format(self, a: dict, seq: int) -> None:
        if a["format"] > FORMAT:
            raise StoreError(f"this store has format {a['format']}; this version reads up to {FORMAT}")
        self.format = max(self.format, a["format"])

    def _restore(self, state: dict) -> None:
        self._format({"format": state.get("format", 1)}, 0)
        self.next = state["next"]
        self.tables = {t["logical_name"]: healed_row(t) for t in state["tables"]}
        if "state" in state:
            for rows in (self.runs, self.versions, self._chunks):
                rows.rest_on(f"{self.folder}/{state['state']}", fresh=True)
            return
        for rows, held in ((self.runs, state["runs"]), (self.versions, state["versions"]), (self._chunks, state["chunks"])):
            for row in held:
                rows.put(healed_row(row))

    def _prepare(self, commits: list[list[dict]]) -> None:
        """Read the rows that actions change, if they lie in the written state, at one go."""
        actions = [a for actions in commits for a in actions]
        self.runs.pull_keys([a["run_id"] for a in actions if a["do"] == "run_update"])
        self.versions.pull_keys([(a["name"], a["hash"]) for a in actions if a["do"] == "version_touch"])
        self._chunks.pull_keys([a["path"] for a in actions if a["do"] == "chunk_delete"])
        for a in actions:
            if a["do"] == "chunk_pack":  # most of a table's chunks
                self._chunks.of_name(a["name"])

    def _take(self, actions: list[dict], n: int) -> None:
        for k, a in enumerate(actions):
            getattr(self, "_" + a["do"])(a, n * 10_000 + k)

    def _run_add(self, a: dict, seq: int) -> None:
        self.runs.put({f: a["run"].get(f) for f in RUN_FIELDS} | {"seq": seq})

    def _run_update(self, a: dict, seq: int) -> None:
        if a["run_id"] in self.runs:
            self.runs.put(self.runs[a["run_id"]] | a["set"])
        elif "run_id" in a["set"]:  # its row was deleted while it ran: what it has done is recorded all the same
            self._run_add({"run": a["set"]}, seq)

    def _run_delete(self, a: dict, seq: int) -> None:
        self.runs.drop(a["run_id"])

    def _version_add(self, a: dict, seq: int) -> None:
        self.versions.put(healed_row(a["version"]) | {"seq": seq})

    def _version_touch(self, a: dict, seq: int) -> None:
        if (a["name"], a["hash"]) in self.versions:
            self.versions.put(self.versions[a["name"], a["hash"]] | {"last_seen": a["at"]} | a.get("set", {}))

    def _version_delete(self, a: dict, seq: int) -> None:
        self.versions.drop((a["name"], a["hash"]))

    def _table_add(self, a: dict, seq: int) -> None:
        self.tables[a["table"]["logical_name"]] = healed_row(dict(a["table"]))

    def _table_schema(self, a: dict, seq: int) -> None:
        if a["name"] in self.tables:
            self.tables[a["name"]]["schema"] = a["schema"]

    def _table_delete(self, a: dict, seq: int) -> None:
        self.tables.pop(a["name"], None)

    def _chunk_add(self, a: dict, seq: int) -> None:
        c = a["chunk"]
        self._chunks.put(healed_row(c) | {"seq": seq})
        t = self.tables[c["logical_name"]]
        t["last_seen"], t["row_count"], t["size_bytes"] = c["started_at"], t["row_count"] + c["rows_appended"], t["size_bytes"] + c["size_bytes"]

    def _chunk_pack(self, a: dict, seq: int) -> None:
        for path in a["paths"]:
            if path in self._chunks:
                self._chunks.put(self._chunks[path] | {"pack": a["pack"], "schema": a["schema"]})

    def _chunk_delete(self, a: dict, seq: int) -> None:
        if a["path"] in self._chunks:
            c = self._chunks[a["path"]]
            t = self.tables.get(c["logical_name"])
            if t:
                t["row_count"], t["size_bytes"] = t["row_count"] - c["rows_appended"], t["size_bytes"] - c["size_bytes"]
        self._chunks.drop(a["path"])

    # Lookups that many operations share.

    def known(self, words: set[str] | None = None) -> set[str]:
        """The names that are in use, or those of them among words."""
        names = self.versions.names(words) | self._chunks.names(words) | set(self.tables)
        return names if words is None else names & words

    def shape(self, name: str) -> str | None:
        if self.versions.of_name(name):
            return "versioned"
        return "append" if name in self.tables else None

    def of_name(self, name: str, rebinds: bool = False) -> list[dict]:
        """Versions of a name, oldest first: by first_seen, then commit."""
        rows = [v for v in self.versions.of_name(name) if rebinds or not v.get("is_rebind")]
        return sorted(rows, key=lambda v: (v["first_seen"], v["seq"]))

    def chunks_of(self, name: str, run_id: str | None = None) -> list[dict]:
        return sorted((c for c in self._chunks.of_name(name) if run_id in (None, c["run_id"])), key=lambda c: c["seq"])

    def newest_run(self, **wanted) -> dict | None:
        """The run that started last (the later commit of equals) of those that a RunFilter takes."""
        return self.runs.newest(RunFilter(**wanted))
