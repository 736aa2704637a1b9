"""Sweeps: lists of envelopes, each a set of bindings for one run."""

from __future__ import annotations

import itertools
import warnings

from .names import StoreError, valid_name
from .refs import Variant


class Batch(list):
    """Envelopes of a sweep: dicts of name to value, with the run's label under ".label"."""


def _labelled(envelopes: list[dict], labels: list[str] | None) -> Batch:
    if labels is not None:
        if len(labels) != len(envelopes):
            raise StoreError(f"{len(labels)} labels for {len(envelopes)} envelopes")
        envelopes = [e | {".label": x} for e, x in zip(envelopes, labels, strict=True)]
    names = [e[".label"] for e in envelopes if e.get(".label")]
    if len(set(names)) < len(names):
        warnings.warn("some envelopes have the same label", stacklevel=3)
    return Batch(envelopes)


def binds(mode: str = "zip", labels: list[str] | None = None, **slots) -> Batch:
    """Envelopes from lists of values. zip goes along the lists (a single value is for all); cross takes every combination, the first slot fastest."""
    if not slots:
        raise StoreError("a sweep needs a name to bind")
    lists = {valid_name(k): list(v) if isinstance(v, (list, tuple, range)) else [v] for k, v in slots.items()}
    if any(not v for v in lists.values()):
        raise StoreError("a sweep has at least one value for each name")
    if mode == "zip":
        n = max(map(len, lists.values()))
        if any(len(v) not in (1, n) for v in lists.values()):
            raise StoreError(f"lists of a zip have the same length or one value: {({k: len(v) for k, v in lists.items()})}")
        rows = [{k: v[i if len(v) > 1 else 0] for k, v in lists.items()} for i in range(n)]
    elif mode == "cross":
        rows = [dict(zip(lists, reversed(c), strict=True)) for c in itertools.product(*reversed(lists.values()))]
    else:
        raise StoreError("mode is zip or cross")
    return _labelled(rows, labels)


def variants_of(*labels: str) -> list[Variant]:
    """References to labelled runs, as values of a sweep's slot."""
    return [Variant(x) for x in labels]


def envelopes(*parts: dict) -> Batch:
    """Envelopes written by hand."""
    if not parts or any(not isinstance(p, dict) for p in parts):
        raise StoreError("envelopes are dicts of name to value")
    return _labelled([dict(p) for p in parts], None)
