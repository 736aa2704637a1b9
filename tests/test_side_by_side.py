"""Leases of picked-up runs and sweeps whose runs go side by side."""

import builtins
import threading
import time
import warnings
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import tallyrun as t


def now(ahead=timedelta()):
    return lambda: datetime.now(UTC).replace(tzinfo=None) + ahead


@pytest.fixture
def store(spark, tmp_path):
    return t.Store(spark, str(tmp_path / "store"))


WRITE = "def write(ctx):\n    ctx.stow(ctx.spark.range(3), 'rows')\n"


def write(ctx):
    ctx.stow(ctx.spark.range(3), "rows")


# --- leases ---------------------------------------------------------------------------------


def test_a_dead_process_loses_its_claim(spark, store):
    run = store.queue(write, text=WRITE, label="later")
    dead = t.Store(spark, store.files.root, clock=now(-timedelta(hours=1)))  # claimed an hour ago, appended, and was killed
    dead.log.commit(lambda: [{"do": "run_update", "run_id": run, "set": {"status": "claimed", "lease": "x", "lease_until": dead.now()}}])
    dead.stow(spark.range(9), "rows")
    dead.log.commit(lambda: [{"do": "chunk_delete", "path": dead.log.chunks[-1]["path"]}, {"do": "chunk_add", "chunk": dead.log.chunks[-1] | {"run_id": run}}])
    assert store.grab("rows", run="all").count() == 9
    assert store.launch(t.Run(run)) == run
    assert store.grab("rows", run="all").count() == 3, "what the dead process appended for this run has gone"
    assert t.Store(spark, store.files.root).runs().where(F.col("run_id") == run).first().status == "success"


def test_a_claim_within_its_lease_stands(spark, store):
    run = store.queue(write, text=WRITE)
    until = (datetime.now(UTC) + timedelta(minutes=5)).replace(tzinfo=None).isoformat(timespec="microseconds")
    store.log.commit(lambda: [{"do": "run_update", "run_id": run, "set": {"status": "claimed", "lease": "x", "lease_until": until}}])
    with pytest.raises(t.StoreError, match="another process"):
        store.launch(t.Run(run))
    assert store.discard_queued() == []
    later = t.Store(spark, store.files.root, clock=now(timedelta(minutes=6)))
    assert later.discard_queued(dry_run=True) == [run] == later.discard_queued()
    with pytest.raises(t.StoreError):
        store.launch(t.Run(run))


def test_leases_are_renewed_while_a_step_runs(spark, tmp_path):
    store = t.Store(spark, str(tmp_path / "store"), lease="3s")
    seen = []

    def slow(ctx):
        for _ in range(8):
            time.sleep(0.5)
            seen.append(ctx.store.log.runs[ctx.run_id]["lease_until"])

    builtins.tr_slow = slow
    try:
        run = store.queue(slow, text="def slow(ctx):\n    tr_slow(ctx)\n")
        store.launch(t.Run(run))
    finally:
        del builtins.tr_slow
    assert len(set(seen)) >= 3 and store.log.runs[run]["status"] == "success"


def test_who_was_taken_over_commits_nothing_more(spark, store):
    """A process that was thought dead wakes up after another has done its run."""
    asleep, woken, failed = threading.Event(), threading.Event(), []
    builtins.tr_wait = lambda: (asleep.set(), woken.wait(60)) if not asleep.is_set() else None
    run = store.queue(write, text="def write(ctx):\n    tr_wait()\n    ctx.stow(ctx.spark.range(3), 'rows')\n")

    def first():
        try:
            t.Store(spark, store.files.root).launch(t.Run(run))
        except t.StoreError as e:
            failed.append(str(e))

    thread = threading.Thread(target=first)
    thread.start()
    try:
        assert asleep.wait(60)
        other = t.Store(spark, store.files.root, clock=now(timedelta(hours=1)))
        other.launch(t.Run(run))
    finally:
        woken.set()
        thread.join()
        del builtins.tr_wait
    assert failed and "taken over" in failed[0]
    assert other.grab("rows", run="all").count() == 3 and other.log.runs[run]["status"] == "success"


# --- sweeps ---------------------------------------------------------------------------------


def test_sweeps_side_by_side_have_the_rows_of_the_loop(spark, store, tmp_path):
    def step(ctx):
        n = ctx.grab("n")
        ctx.stow(spark.range(n).select(F.lit(n).alias("n"), F.sum("id").over(t_window).alias("total")).distinct(), "totals")
        ctx.stow(n * 2, f"twice{n}")

    from pyspark.sql import Window

    t_window = Window.partitionBy(F.lit(1))
    step.__globals__["t_window"] = t_window
    ns = [5, 3, 8, 1, 9, 2, 7]
    other = t.Store(spark, str(tmp_path / "other"))
    loop = other.launch(step, rebind=t.binds(n=ns), text="step").collect()
    wide = store.launch(step, rebind=t.binds(n=ns, labels=[f"l{n}" for n in ns]), text="step", parallel=4).collect()
    assert [r.status for r in loop] == [r.status for r in wide] == ["success"] * 7
    assert [r.variant_label for r in wide] == [f"l{n}" for n in ns] and len({r.run_id for r in wide}) == 7
    rows = lambda s: sorted((r.n, r.total) for r in s.grab("totals", run="all").collect())
    assert rows(store) == rows(other) == sorted((n, n * (n - 1) // 2) for n in ns)
    for r, n in zip(wide, ns):
        row = store.log.runs[r.run_id]
        assert [o.get("name") or o["logical_name"] for o in row["outputs"]] == ["totals", f"twice{n}"] and [p["name"] for p in row["inputs"]] == ["n"]
        assert store.grab("totals", run=r.run_id).first().n == n


def test_runs_are_at_work_at_the_same_time_but_no_more_than_asked(spark, store):
    inside, most, lock, both = [0], [0], threading.Lock(), threading.Barrier(3, timeout=30)

    def step(ctx):
        with lock:
            inside[0] += 1
            most[0] = max(most[0], inside[0])
        both.wait()
        assert ctx.store.spark.sparkContext.getLocalProperty("spark.scheduler.pool") == ctx.run_id
        with lock:
            inside[0] -= 1

    store.launch(step, rebind=t.binds(n=list(range(9))), text="step", parallel=3)
    assert most[0] == 3


def test_failures_are_told_apart(spark, store):
    def step(ctx):
        ctx.stow(10 // ctx.grab("n"), "out")

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = store.launch(step, rebind=t.binds(n=[1, 0, 2, 0]), text="step", parallel=4, on_error="warn").collect()
    assert [r.status for r in got] == ["success", "error", "success", "error"] and "zero" in got[1].error
    with pytest.raises(t.StoreError, match="2 of 4"):
        store.launch(step, rebind=t.binds(n=[1, 0, 2, 0]), text="step", parallel=2, force=True)
    for bad in (0, -1):
        with pytest.raises(t.StoreError, match="parallel"):
            store.launch(step, rebind=t.binds(n=[1]), parallel=bad)
    with pytest.raises(t.StoreError, match="parallel"):
        store.launch(step, parallel=2)
