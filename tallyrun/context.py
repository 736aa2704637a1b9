"""What a running step has read and written, and what its names are bound to."""

from __future__ import annotations

from contextvars import ContextVar
from dataclasses import dataclass, field


@dataclass
class Binding:
    """What a name stands for while a step runs: a version of a versioned name, or the rows of a run of an append name."""

    name: str
    shape: str
    hash: str | None
    run_id: str | None
    source: str
    value: str | None

    def record(self) -> dict:
        return {"name": self.name, "source": self.source, "value": self.value, "hash": self.hash, "shape": self.shape, "filter_kind": "run" if self.run_id else None, "filter_value": self.run_id}


@dataclass
class RunContext:
    run_id: str
    step: str
    label: str | None
    seed: float | None
    bindings: dict[str, Binding]
    inputs: dict[tuple, dict] = field(default_factory=dict)
    outputs: list[dict] = field(default_factory=list)
    helpers: dict[str, str] = field(default_factory=dict)
    lease: str | None = None  # what a picked-up run was claimed with
    grabs: int = 0
    stows: int = 0

    def read(self, name: str, hash_: str | None) -> None:
        self.grabs += 1
        self.inputs.setdefault((name, hash_), {"name": name, "hash": hash_})

    def wrote(self, entry: dict) -> None:
        self.stows += 1
        if "kind" in entry or entry not in self.outputs:
            self.outputs.append(entry)


CURRENT: ContextVar[RunContext | None] = ContextVar("tallyrun_run", default=None)


def output_matches(entry: dict, name: str, hash_: str | None = None) -> bool:
    """Whether an output entry of a run is of a name (and, for versioned names, of a hash)."""
    if "logical_name" in entry:
        return entry["logical_name"] == name and hash_ in (None, entry["chunk_hash"])
    return entry["name"] == name and hash_ in (None, entry["hash"])


def output_identity(entry: dict) -> tuple[str, str]:
    return (entry["logical_name"], entry["chunk_hash"]) if "logical_name" in entry else (entry["name"], entry["hash"])
