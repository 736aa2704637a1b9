"""Whether a step has to run again, and why."""

from __future__ import annotations

import os

from .functions.hashing import md5, normal_code
from .names import StoreError
from .refs import Label, Variant


def anchor(store, step: str, label: str | None) -> dict | None:
    """The run that freshness is measured against: the newest of the step that succeeded (with the label, if one is given).

    Skipped and failed runs don't count: the first have no inputs to compare, the second no results to keep."""
    return store.log.newest_run(step=step, status="success", label=label)


def head(store, name: str) -> str | None:
    """The hash that reading a name records now."""
    if store.log.shape(name) == "append":
        run = store.newest_append_run(name)
        return store.chunk_hash(name, run) if run else None
    rows = store.log.of_name(name)
    return rows[-1]["content_hash"] if rows else None


def reasons(store, step: str, label: str | None, own_hash: str | None, bindings: dict | None = None) -> list[str]:
    """never_run; code, code_unknown; input:<name>; external:<path>; external:env:<name>. Empty if fresh.

    own_hash: of the step's code now, without helpers; None if it can't be had. Helpers are
    those of the last success, read anew. Inputs are compared with what they are bound to,
    or with their newest value."""
    from .functions.hashing import code_hash

    prior = anchor(store, step, label)
    if not prior:
        return ["never_run"]
    out = []
    if prior["code_hash"] is None:
        out.append("code_unknown")
    else:
        now = []
        for h in prior["helpers"] or ():
            now.append(md5(normal_code(open(h["path"], "rb").read())) if os.path.exists(h["path"]) else "gone")
        if own_hash is None or code_hash(own_hash, now) != prior["code_hash"]:
            out.append("code")
    bindings = bindings or {}
    for p in prior["inputs"] or ():
        name = p["name"]
        current = bindings[name].hash if name in bindings else head(store, name)
        if p["hash"] is None:
            if name in bindings:
                out.append(f"input:{name}")
        elif current != p["hash"]:
            out.append(f"input:{name}")
    for f in (prior["external_inputs"] or {}).get("files", ()):
        if not os.path.exists(f["path"]) or md5(open(f["path"], "rb").read()) != f["hash"]:
            out.append(f"external:{f['path']}")
    for e in (prior["external_inputs"] or {}).get("env", ()):
        if (md5(os.environ[e["name"]]) if e["name"] in os.environ else None) != e["hash"]:
            out.append(f"external:env:{e['name']}")
    return list(dict.fromkeys(out))


def is_stale(store, what) -> tuple[bool, list[str]]:
    """Of the newest run of a label: whether its step would run again now."""
    if not isinstance(what, (Label, Variant)):
        raise StoreError("is_stale() takes a Label or a Variant")
    store.log.replay()
    run = store.log.newest_run(label=what.value, not_status=("queued", "interactive"))
    if not run:
        return True, ["never_run"]
    from .steps import current_hash

    found = reasons(store, run["step"], what.value, current_hash(run))
    return bool(found), found
