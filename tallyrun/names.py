"""Names, labels and the options of a store."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass
from pathlib import Path

SYSTEM = "_tr_"
RUN_COLUMN, LABEL_COLUMN = "_tr_run_id", "_tr_variant_label"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class StoreError(ValueError):
    """A request that the store refuses, with nothing changed."""


def valid_name(name: object) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name) or len(name) > 255:
        raise StoreError(f"a name has letters, digits and _, up to 255, and no digit first: {name!r}")
    if name.lower().startswith(SYSTEM):
        raise StoreError(f"names starting with {SYSTEM} are reserved: {name!r}")
    return name


def valid_label(label: object) -> str | None:
    if label is None:
        return None
    if not isinstance(label, str) or not label.strip():
        raise StoreError(f"a label is a string that is not blank: {label!r}")
    return label


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Options:
    """blob_threshold: bytes from which an artifact is a file of its own. version_warn: versions of a name that call for pruning. lease: how long a picked-up run is its process's without a sign of life."""

    blob_threshold: int = 10_000_000
    version_warn: int = 20
    skip_if_fresh: bool = True
    relaunch_nonsuccess: str = "warn"
    widen_numbers: bool = False
    lease: str = "10m"
    project_stop_at: str | None = None


MARKERS = ("pyproject.toml", "setup.cfg", ".git", ".here")


def project_root(start: str | None = None, stop_at: str | None = None) -> str:
    """The nearest folder from ``start`` upwards that has a marker; with a warning, ``start`` itself."""
    here = Path(start or os.getcwd()).resolve()
    for folder in (here, *here.parents):
        if any((folder / m).exists() for m in MARKERS):
            return str(folder)
        if stop_at and folder == Path(stop_at).resolve():
            break
    warnings.warn(f"no project marker above {here}; the store lies there", stacklevel=2)
    return str(here)


def store_root(spark=None, stop_at: str | None = None) -> str:
    """Where the store lies: spark.tallyrun.store, TALLYRUN_STORE, or below the project's root."""
    named = spark.conf.get("spark.tallyrun.store", None) if spark else None
    return named or os.environ.get("TALLYRUN_STORE") or os.path.join(project_root(stop_at=stop_at), "tallyrun_store")
