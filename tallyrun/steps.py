"""Running steps: code in, a recorded run out."""

from __future__ import annotations

import logging
import os
import time
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from . import capture, identity, sqlstep, staleness
from .context import CURRENT, Binding, RunContext
from .functions.hashing import code_hash, md5, normal_code
from .names import StoreError, valid_label, valid_name
from .refs import REFS, AsOf, Code, Hash, Label, Run, Sql, Variant, moment
from .log import stamp
from .store import Store, new_id, source_of
from .sweeps import Batch

said = logging.getLogger("tallyrun")


@dataclass
class Step:
    """Code that can be run: kind is function, script or sql; name its identity in the history."""

    kind: str
    name: str
    body: str
    own_hash: str
    function: Callable | None = None
    path: str | None = None


def step_of(code, text: str | None = None) -> Step:
    """A function, the path of a .py or .sql file, or a Sql body as a step. A function given with a text is that text, whatever values it carries."""
    if isinstance(code, Sql):
        h = md5(normal_code(code.value))
        return Step("sql", f"<inline:sql:{h[:12]}>", code.value, h)
    if callable(code):
        body = text or identity.with_values(source_of(code), code)
        h = md5(normal_code(body))
        return Step("function", f"<inline:{h[:12]}>", body, h, function=code)
    if isinstance(code, (str, os.PathLike)):
        path = os.fspath(code)
        kind = {".py": "script", ".sql": "sql"}.get(os.path.splitext(path)[1])
        if not kind:
            raise StoreError(f"{path} is neither a .py nor a .sql file")
        if not os.path.exists(path):
            raise StoreError(f"{path} does not exist")
        with open(path, "rb") as f:
            data = normal_code(f.read())
        return Step(kind, path, data.decode(), md5(data), path=path)
    raise StoreError("a step is a function, a .py or .sql file, a Sql body, a Label or a Run")


def current_hash(run: dict) -> str | None:
    """Hash of a recorded step's code as it is now: of its file, or of what was recorded for inline code."""
    if run["step"].startswith("<"):
        return md5(normal_code(run["code_body"])) if run["code_body"] is not None else None
    if not os.path.exists(run["step"]):
        return None
    with open(run["step"], "rb") as f:
        return md5(normal_code(f.read()))


def recorded_step(run: dict) -> Step:
    """The step of a recorded run: its file as it is now, or else the recorded text."""
    if run["step"].startswith("<interactive"):
        raise StoreError(f"{run['run_id']} was a write by hand; there is no code to run")
    if not run["step"].startswith("<") and os.path.exists(run["step"]):
        return step_of(run["step"])
    if run["code_body"] is None:
        raise StoreError(f"no code was recorded for {run['run_id']}")
    if not run["step"].startswith("<"):
        said.warning("%s is gone; its recorded text is run", run["step"])
    kind = "sql" if run["step"].startswith("<inline:sql:") or run["step"].endswith(".sql") else "text" if run["step"].startswith("<") else "script"
    return Step(kind, run["step"], run["code_body"], md5(normal_code(run["code_body"])), path=None if run["step"].startswith("<") else run["step"])


def resolve(store: Store, rebind: dict | None, record: bool = True) -> dict[str, Binding]:
    """What names are bound to for a run. Values that aren't references are stored first, out of sight of newest reads."""
    out = {}
    for name, value in (rebind or {}).items():
        if name == ".label":
            continue
        valid_name(name)
        shape = store.log.shape(name)
        if shape == "append":
            out[name] = _resolve_append(store, name, value)
        elif isinstance(value, REFS):
            kind = type(value).__name__.lower()
            v = store.version_row(name, **{{"hash": "version", "run": "from_run", "variant": "variant", "asof": "as_of"}[kind]: value.value})
            out[name] = Binding(name, "versioned", v["content_hash"], None, kind, _say(value))
        elif isinstance(value, (DataFrame, pd.DataFrame)):
            h = store._stow_table(store._frame(value), name, is_rebind=True, record=False)
            out[name] = Binding(name, "versioned", h, None, "literal", None)
        else:
            kinds = {v["kind"] for v in store.log.of_name(name, rebinds=True)}
            if kinds - {"artifact"}:
                raise StoreError(f"{name} holds a {kinds.pop()}; bind it to a frame or a reference")
            h = store._stow_artifact(value, name, is_rebind=True, record=False)
            out[name] = Binding(name, "versioned", h, None, "literal", repr(value)[:200])
    return out


def _say(ref) -> str:
    return stamp(moment(ref.value)) if isinstance(ref, AsOf) else str(ref.value)


def _resolve_append(store: Store, name: str, value) -> Binding:
    if not isinstance(value, REFS):
        raise StoreError(f"{name} is an append table; bind it to a Hash, Run, Variant or AsOf")
    chunks = store.log.chunks_of(name)
    if isinstance(value, Hash):
        mine = [c for c in chunks if c["chunk_hash"] == value.value]
        run = max(mine, key=lambda c: c["seq"])["run_id"] if mine else None
    elif isinstance(value, Run):
        run = value.value if any(c["run_id"] == value.value for c in chunks) else None
    elif isinstance(value, Variant):
        run = store.newest_append_run(name, value.value)
    else:
        limit = stamp(moment(value.value))
        found = store.log.newest_run(ids={c["run_id"] for c in chunks}, until=limit)
        run = found["run_id"] if found else None
    if run is None:
        raise StoreError(f"{name} has no rows of {value}")
    return Binding(name, "append", store.chunk_hash(name, run), run, type(value).__name__.lower(), _say(value))


def inherited_label(store: Store, inputs: list[dict]) -> str | None:
    """The label that the makers of all labelled inputs agree on. If they differ there is none, with a warning."""
    labels = set()
    for p in inputs:
        maker = store.log.newest_run(output=(p["name"], p["hash"]))
        if maker and maker["variant_label"]:
            labels.add(maker["variant_label"])
    if len(labels) > 1:
        warnings.warn(f"inputs have different labels {sorted(labels)}; the run has none", stacklevel=3)
    return labels.pop() if len(labels) == 1 else None


def warn_of_handwork(store: Store, inputs: list[dict]) -> None:
    for p in inputs:
        maker = store.log.newest_run(output=(p["name"], p["hash"]))
        if maker and maker["status"] == "interactive":
            warnings.warn(f"{p['name']} was written by hand, not by a step", stacklevel=3)


class Include:
    """Runs helper files in a step's namespace and notes the hash of each, once."""

    def __init__(self, context: RunContext, space: dict):
        self.context, self.space, self.open = context, space, []

    def __call__(self, path: str) -> None:
        full = os.path.abspath(path)
        if full in self.open:
            return
        with open(full, "rb") as f:
            data = normal_code(f.read())
        self.context.helpers[full] = md5(data)
        self.open.append(full)
        try:
            exec(compile(data, full, "exec"), self.space)
        finally:
            self.open.pop()


class Ctx:
    """What a step's function is called with."""

    def __init__(self, store: Store, context: RunContext):
        self.store, self.spark, self.grab, self.stow, self.sample = store, store.spark, store.grab, store.stow, store.sample
        self.seed, self.run_id, self.label = context.seed, context.run_id, context.label
        self.include = Include(context, {"grab": store.grab, "stow": store.stow, "spark": store.spark, "store": store})


def _execute(store: Store, step: Step, context: RunContext, materialize: bool) -> None:
    if step.kind == "function":
        wants = step.function.__code__.co_argcount - (getattr(step.function, "__self__", None) is not None) if hasattr(step.function, "__code__") else 1
        context.helpers |= identity.helpers_of(step.function)
        step.function(*([Ctx(store, context)] if wants else []))
    elif step.kind == "sql":
        script = sqlstep.parse(step.body)
        output = script.output or (os.path.splitext(os.path.basename(step.path))[0] if step.path else None)
        if not output:
            raise StoreError("inline SQL names its result: -- @output: name")
        valid_name(output)
        sqlstep.check(store, script.body)
        strange = set(context.bindings) - set(script.inputs)
        if strange:
            raise StoreError(f"bound but not among @inputs: {sorted(strange)}")
        bound = sqlstep.bind(store, script.inputs)
        store._guard(output, "versioned", "table" if materialize else "view")
        df = sqlstep.frame_of(store, script.body, bound)
        for b in bound.values():
            context.read(b.name, b.hash)
        if materialize:
            store._stow_table(df, output, source={"source_sql": script.body})
        else:
            digest = md5(script.body + "\n" + "\n".join(sorted(f"{b.name}={b.hash}" for b in bound.values())))
            store._commit_version(output, digest, "view", {"source_sql": script.body, "bindings": [b.record() for b in bound.values()]}, False, None, True)
    else:
        space = {"grab": store.grab, "stow": store.stow, "spark": store.spark, "store": store, "__name__": "__main__", "__file__": step.path}
        space["include"] = Include(context, space)
        if step.kind == "text":  # a recorded function
            space["ctx"] = Ctx(store, context)
            above, mark, body = step.body.partition(identity.STEP + "\n")
            if mark:  # what the function needs of its module
                exec(compile(above, step.name, "exec"), space)
            before = set(space)
            exec(compile((body if mark else above).strip(), step.name, "exec"), space)
            made = [v for k, v in space.items() if k not in before and callable(v) and hasattr(v, "__code__")]
            if not made:
                raise StoreError("the recorded code is no function definition; pass the function again")
            made[-1](*([space["ctx"]] if made[-1].__code__.co_argcount else []))
        else:
            with identity.beside(step.path):
                context.helpers |= identity.helpers_of_text(step.body)
                exec(compile(step.body, step.path or step.name, "exec"), space)


def launch(store: Store, code, rebind=None, label: str | None = None, external_inputs: dict | None = None, force: bool = False, seed: float | None = None, materialize: bool | None = None, on_error: str | None = None, text: str | None = None, parallel: int = 1):
    """Run a step and record the run; return its id, or a DataFrame of a sweep's runs.

    code: a function (of nothing, or of a context with grab, stow, sample and include), a .py
    or .sql file, a Sql body, or what a recorded run did: a Label (its newest run) or a Run.
    A queued Run is picked up in place. rebind: a dict of names to values or references, or a
    Batch of such for a sweep. A step that is fresh is skipped unless force is set.
    external_inputs: {"files": [...], "env": [...]} outside the store that the step depends on.
    parallel: runs of a sweep at a time.
    """
    from .queue import pick_up, template

    if CURRENT.get():
        raise StoreError("a step can't launch another step")
    label = valid_label(label)
    if seed is not None and not (isinstance(seed, (int, float)) and -1 <= seed <= 1):
        raise StoreError("a seed is a number from -1 to 1")
    if on_error is not None and not isinstance(rebind, Batch):
        raise StoreError("on_error is for sweeps")
    if parallel < 1 or parallel > 1 and not isinstance(rebind, Batch):
        raise StoreError("parallel is a number of runs of a sweep")
    if on_error not in (None, "stop", "warn"):
        raise StoreError("on_error is stop or warn")
    store.log.replay()
    if isinstance(code, Run):
        prior = store.log.runs.get(code.value)
        if not prior:
            raise StoreError(f"there is no run {code.value}")
        if prior["status"] in ("queued", "claimed"):
            if rebind is None or prior["status"] == "claimed":
                return pick_up(store, prior, force)
            code, label, external_inputs, seed, materialize = template(prior, label, external_inputs, seed, materialize)
            rebind = rebind if isinstance(rebind, Batch) else dict(rebind)
            step = code
        else:
            policy = store.options.relaunch_nonsuccess
            if prior["status"] != "success" and policy != "silent":
                if policy == "error":
                    raise StoreError(f"{code.value} ended as {prior['status']}")
                warnings.warn(f"{code.value} ended as {prior['status']}", stacklevel=3)
            step = recorded_step(prior)
            label = label or prior["variant_label"]
            materialize = prior["materialize"] if materialize is None else materialize
    elif isinstance(code, Label):
        prior = store.log.newest_run(label=code.value, not_status=("queued", "interactive"))
        if not prior:
            raise StoreError(f"no run is labelled {code.value}")
        step, label = recorded_step(prior), label or code.value
        materialize = prior["materialize"] if materialize is None else materialize
    else:
        step = step_of(code, text)
    if materialize and step.kind != "sql":
        raise StoreError("materialize is for SQL steps")
    if step.kind == "sql" and not step.path and not sqlstep.parse(step.body).output:
        raise StoreError("inline SQL names its result: -- @output: name")
    if isinstance(rebind, Batch):
        return _sweep(store, step, rebind, label, external_inputs, force, seed, bool(materialize), on_error or "stop", parallel)
    return run_one(store, step, rebind, label, external_inputs, force, seed, bool(materialize))


def run_one(store: Store, step: Step, rebind, label, external_inputs, force, seed, materialize, batch_id=None, queued: dict | None = None, lease: str | None = None, run_id: str | None = None) -> str:
    """One run: outside inputs, bindings, freshness, then the code, and its row in the history whatever happens."""
    outside = queued["external_inputs"] if queued and external_inputs is None else capture.external(**(external_inputs or {}))
    about = capture.session(store.spark) | capture.git()
    bindings = rebind if rebind and all(isinstance(b, Binding) for b in rebind.values()) else resolve(store, rebind)
    at = store.now()
    run_id = queued["run_id"] if queued else run_id or new_id("run", at)
    row = {"step": step.name, "run_id": run_id, "started_at": at, "variant_label": label, "code_body": step.body, "external_inputs": outside, "seed": seed, "rebinds": [b.record() for b in bindings.values()], "batch_id": batch_id, "materialize": materialize} | about

    def save(**more) -> None:
        final = row | more

        def build() -> list[dict]:
            if lease and store.log.runs.get(run_id, {}).get("lease", lease) != lease:
                raise StoreError(f"{run_id} has been taken over by another process")
            return [{"do": "run_update", "run_id": run_id, "set": final} if queued else {"do": "run_add", "run": final}]

        store.log.commit(build)

    why = staleness.reasons(store, step.name, label, step.own_hash, bindings)
    if outside != ((staleness.anchor(store, step.name, label) or {}).get("external_inputs") or outside):
        why.append("external")
    if not why and not force and store.options.skip_if_fresh:
        last = staleness.anchor(store, step.name, label)
        save(status="skipped_fresh", inputs=[], outputs=[], helpers=[], duration_ms=0, code_hash=last["code_hash"], variant_label=last["variant_label"])
        said.info("%s is fresh", step.name)
        return run_id
    said.info("%s runs: %s", step.name, ", ".join(why) or "forced")
    context = RunContext(run_id, step.name, label, seed, bindings, lease=lease)
    token, began, status, error = CURRENT.set(context), time.monotonic(), "success", None
    try:
        _execute(store, step, context, materialize)
    except BaseException as e:
        status, error = "error", e
    finally:
        CURRENT.reset(token)
    inputs = list(context.inputs.values())
    warn_of_handwork(store, inputs)
    if label is None and status == "success":
        row["variant_label"] = inherited_label(store, inputs)
    helpers = [{"path": p, "hash": h} for p, h in context.helpers.items()]
    took = int(1000 * (time.monotonic() - began))
    of = row["variant_label"] and f"; variant {row['variant_label']}" + ("" if label else ", as its inputs")
    said.info("%s ended as %s after %s ms: %d reads, %d writes%s", os.path.basename(step.name), status, f"{took:,}", context.grabs, context.stows, of or "")
    save(status=status, inputs=inputs, outputs=context.outputs, helpers=helpers, duration_ms=took, code_hash=code_hash(step.own_hash, list(context.helpers.values())))
    if error:
        raise error
    return run_id


BATCH_COLUMNS = ("batch_id", "run_id", "variant_label", "status", "error")


def _sweep(store, step, envelopes, label, external_inputs, force, seed, materialize, on_error, parallel=1) -> DataFrame:
    """A run for each envelope, ``parallel`` at a time. An error ends its own run; all are reported at the end, in the order of the envelopes.

    Runs side by side share Spark: each has a fair pool of its own and its jobs carry the
    batch and the run as tags. Leaving the sweep early (an interrupt) cancels what is under way.
    """
    from . import schema as metadata

    batch_id, context = new_id("batch", store.now()), store.spark.sparkContext
    planned = [(e, valid_label(e.get(".label")) or label, new_id("run", store.now())) for e in envelopes]

    def one(envelope, own, run_id) -> Exception | None:
        tags = [batch_id, run_id] if parallel > 1 else []
        if parallel > 1:
            context.setLocalProperty("spark.scheduler.pool", run_id)
        for tag in tags:
            context.addJobTag(tag)
        try:
            run_step(store, step, envelope, own, external_inputs, force, seed, materialize, batch_id, run_id)
        except Exception as x:
            return x
        finally:
            for tag in tags:
                context.removeJobTag(tag)
        return None

    if parallel > 1:
        with ThreadPoolExecutor(parallel, thread_name_prefix=batch_id) as pool:
            threads = [pool.submit(inheritable_thread_target(store.spark)(one), *p) for p in planned]
            try:
                errors = [t.result() for t in threads]
            except BaseException:
                for t in threads:
                    t.cancel()
                context.cancelJobsWithTag(batch_id)
                raise
    else:
        errors = [one(*p) for p in planned]
    rows, failed = [], [x for x in errors if x]
    for (_, own, run_id), error in zip(planned, errors, strict=True):
        run = store.log.runs.get(run_id) or {}
        rows.append({"batch_id": batch_id, "run_id": run.get("run_id"), "variant_label": run.get("variant_label", own), "status": run.get("status", "error"), "error": str(error) if error else None})
    if failed:
        if on_error == "stop":
            raise StoreError(f"{len(failed)} of {len(rows)} runs of {batch_id} failed; the first with: {failed[0]}") from failed[0]
        warnings.warn(f"{len(failed)} of {len(rows)} runs of {batch_id} failed", stacklevel=4)
    return metadata.frame(store.spark, rows, BATCH_COLUMNS)


def run_step(store, step, envelope, label, external_inputs, force, seed, materialize, batch_id, run_id=None) -> str:
    return run_one(store, step, {k: v for k, v in envelope.items() if k != ".label"}, label, external_inputs, force, seed, materialize, batch_id, run_id=run_id)


def launch_code(store: Store, run_id: str, from_db: bool = False) -> Code:
    """The code of a run: its file as it is now, or (from_db, or if the file is gone) as it was recorded."""
    run = store.log.runs.get(run_id)
    if not run:
        raise StoreError(f"there is no run {run_id}")
    if not from_db and not run["step"].startswith("<") and os.path.exists(run["step"]):
        with open(run["step"], encoding="utf-8") as f:
            return Code(f.read())
    if run["code_body"] is None:
        raise StoreError(f"no code was recorded for {run_id}")
    if not from_db and not run["step"].startswith("<"):
        said.warning("%s is gone; this is its recorded text", run["step"])
    return Code(run["code_body"])

