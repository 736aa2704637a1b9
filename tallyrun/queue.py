"""Runs that are staged now and executed later, perhaps by another process."""

from __future__ import annotations

import threading
import uuid
import warnings

from . import capture, sqlstep
from .context import CURRENT, Binding
from .functions.hashing import md5, normal_code
from .functions.scalars import duration
from .log import stamp
from .names import StoreError, valid_label
from .refs import Label, Run, moment
from .store import Store, new_id
from .sweeps import Batch


def _bound(records: list[dict]) -> dict[str, Binding]:
    return {b["name"]: sqlstep.binding_of(b) for b in records or ()}


def queue(store: Store, code, rebind=None, label: str | None = None, external_inputs: dict | None = None, seed: float | None = None, text: str | None = None):
    """Stage a step; its run id, or a list of them for a sweep. A stage that is there already is not made again. SQL steps are not queued."""
    from .steps import recorded_step, resolve, step_of

    if CURRENT.get():
        raise StoreError("a step can't queue another step")
    store.log.replay()
    label = valid_label(label)
    if seed is not None and not (isinstance(seed, (int, float)) and -1 <= seed <= 1):
        raise StoreError("a seed is a number from -1 to 1")
    if isinstance(code, (Run, Label)):
        found = store.log.runs.get(code.value) if isinstance(code, Run) else store.log.newest_run(label=code.value, not_status=("queued", "interactive"))
        if not found:
            raise StoreError(f"there is no run for {code}")
        if found["status"] == "queued":
            raise StoreError(f"{found['run_id']} is queued itself")
        step, label = recorded_step(found), label or found["variant_label"]
    else:
        step = step_of(code, text)
    if step.kind == "sql":
        raise StoreError("SQL steps are launched, not queued")
    outside = capture.external(**(external_inputs or {}))
    single = not isinstance(rebind, Batch)
    envelopes = [rebind or {}] if single else list(rebind)
    batch_id = None if single else new_id("batch", store.now())
    staged, ids = [], []
    for e in envelopes:
        own = valid_label(e.get(".label")) or label
        bindings = resolve(store, {k: v for k, v in e.items() if k != ".label"})
        staged.append((own, [b.record() for b in bindings.values()]))
    rows = []
    for own, records in staged:
        rows.append({"step": step.name, "run_id": new_id("run", store.now()), "inputs": [], "outputs": [], "started_at": None, "queued_at": store.now(), "status": "queued", "code_hash": step.own_hash, "external_inputs": outside, "helpers": [], "variant_label": own, "code_body": step.body, "seed": seed, "rebinds": records, "batch_id": batch_id, "attached_packages": []})

    def build() -> list[dict]:
        actions: list[dict] = []
        ids.clear()
        for row in rows:
            same = next((r["run_id"] for r in [*store.log.runs.values(), *[a["run"] for a in actions]] if r["status"] == "queued" and all(r[k] == row[k] for k in ("step", "code_hash", "variant_label", "rebinds", "external_inputs"))), None)
            if same is None:
                actions.append({"do": "run_add", "run": row})
            ids.append(same or row["run_id"])
        return actions

    store.log.commit(build)
    return ids[0] if single else ids


def expired(store: Store, row: dict) -> bool:
    """Whether a claimed run's process has given no sign of life for longer than its lease (rows of earlier versions have none)."""
    return row["status"] == "claimed" and (row.get("lease_until") or "") < store.now()


def pick_up(store: Store, row: dict, force: bool = False) -> str:
    """Execute a queued run in its own row, or one whose process has died.

    A process claims it by a commit that only a queued row, or a claim with an expired lease,
    allows. The lease is renewed while the step runs. Another process that takes it over
    removes the chunks that the first has appended for this run; should the first be alive
    after all, it can commit nothing more.
    """
    from .steps import recorded_step, run_one

    step = recorded_step(row)
    if md5(normal_code(step.body)) != row["code_hash"]:
        warnings.warn(f"{row['step']} has changed since {row['run_id']} was queued", stacklevel=4)
    run_id, lease, term = row["run_id"], uuid.uuid4().hex, duration(store.options.lease)

    def until() -> str:
        return stamp(moment(store.now()) + term)

    def claim() -> list[dict]:
        now = store.log.runs.get(run_id, {"status": "gone"})
        if now["status"] == "claimed" and not expired(store, now):
            raise StoreError(f"{run_id} is being run by another process; its lease lasts until {now['lease_until']}")
        if now["status"] not in ("queued", "claimed"):
            raise StoreError(f"{run_id} is not queued any more")
        left = [{"do": "chunk_delete", "path": c["path"]} for c in store.log.chunks if c["run_id"] == run_id] if now["status"] == "claimed" else []
        return [*left, {"do": "run_update", "run_id": run_id, "set": {"status": "claimed", "lease": lease, "lease_until": until()}}]

    def ours() -> bool:
        now = store.log.runs.get(run_id, {})
        return now.get("status") == "claimed" and now.get("lease") == lease

    def renew() -> None:
        while not ended.wait(term.total_seconds() / 3):
            store.log.commit(lambda: [{"do": "run_update", "run_id": run_id, "set": {"lease_until": until()}}] if ours() else [])

    store.log.commit(claim)
    ended = threading.Event()
    alive = threading.Thread(target=renew, name=f"lease of {run_id}", daemon=True)
    alive.start()
    try:
        return run_one(store, step, _bound(row["rebinds"]), row["variant_label"], None, force, row["seed"], bool(row["materialize"]), row["batch_id"], queued=row, lease=lease)
    except BaseException:
        failed = [{"do": "run_update", "run_id": run_id, "set": {"status": "error", "started_at": store.now()}}]
        store.log.commit(lambda: failed if ours() else [])
        raise
    finally:
        ended.set()
        alive.join()


def template(row: dict, label, external_inputs, seed, materialize):
    """A queued row as the model of new runs with other bindings; the row stays queued."""
    from .steps import recorded_step

    outside = row["external_inputs"] or {}
    declared = {"files": [f["path"] for f in outside.get("files", ())], "env": [e["name"] for e in outside.get("env", ())]}
    return recorded_step(row), label or row["variant_label"], external_inputs or declared, row["seed"] if seed is None else seed, materialize


def discard_queued(store: Store, variant_label: str | None = None, before=None, dry_run: bool = False) -> list[str]:
    """Delete queued rows, of a label or queued before a time, and those whose process died while it ran them. Their ids."""
    store.log.replay()
    limit = stamp(moment(before)) if before is not None else None
    ids: list[str] = []

    def build() -> list[dict]:
        ids[:] = [r["run_id"] for r in store.log.runs.values() if (r["status"] == "queued" or expired(store, r)) and variant_label in (None, r["variant_label"]) and (limit is None or r["queued_at"] < limit)]
        return [{"do": "run_delete", "run_id": i} for i in ids]

    build() if dry_run else store.log.commit(build)
    return ids
