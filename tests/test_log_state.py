"""A long history: its state lies in Parquet and is read as it is asked for."""

import warnings
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import tallyrun as t
from tallyrun import log as logs


class Ticking:
    def __init__(self):
        self.at = datetime(2024, 1, 1)

    def __call__(self):
        self.at += timedelta(seconds=1)
        return self.at


@pytest.fixture(params=[0, 10**9])
def store(spark, tmp_path, monkeypatch, request):
    """Once with Parquet states every four commits, once with states in one file."""
    monkeypatch.setattr(logs, "WHOLE_ROWS", request.param)
    monkeypatch.setattr(logs, "SNAPSHOT_EVERY", 4)
    monkeypatch.setattr("tallyrun.log_state.FILTER_KEYS", 3)  # more are looked up by a join
    return t.Store(spark, str(tmp_path / "store"), clock=Ticking())


def again(store):
    return t.Store(store.spark, store.files.root, clock=store._clock)


def history(store):
    """Versions, chunks, objects, labels, failures, queued and deleted runs."""
    df = lambda n: store.spark.range(n).withColumn("s", F.lit("x"))
    for k, label in enumerate(["a", "b", "a", None]):
        store.launch(lambda ctx, k=k: ctx.stow(df(k + 1), "t", shape="versioned"), label=label, text=f"make {k}")
        store.launch(lambda ctx, k=k: ctx.stow(df(k + 2), "log"), label=label, text=f"append {k}")
    store.launch(lambda ctx: ctx.stow(ctx.grab("t", variant="a").count(), "n"), text="def use(ctx):\n    ctx.stow(ctx.grab('t', variant='a').count(), 'n')\n")
    store.stow(df(1), "t", shape="versioned")
    with pytest.raises(ZeroDivisionError):
        store.launch(lambda ctx: 1 / 0, text="fails")
    store.queue(lambda ctx: ctx.stow(1, "q"), label="later", text="def later(ctx):\n    ctx.stow(1, 'q')\n")
    gone = store.launch(lambda ctx: ctx.stow(2, "q"), label="gone", text="gone")
    store.prune_variants(store.log.runs[gone]["step"], "gone")
    for k in range(3):
        store.stow(k, "o")
    return store


def listed(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_listings_and_lookups_are_the_same(store):
    history(store)
    lazy = again(store)
    long = logs.WHOLE_ROWS == 0
    assert any(x.endswith(".state") for x in store.files.names(store.log.folder)) == long
    script = next(r["step"] for r in store.log.runs.values() if r["inputs"])
    for one, other in zip(
        *[[listed(s.versions("t")), listed(s.versions("t", include_rebinds=False)), listed(s.versions("log")), listed(s.variants()), listed(s.variants(name="log")), listed(s.variants_unexplored(script)), sorted(map(repr, listed(s.runs()))), sorted(map(repr, listed(s.version_table()))), sorted(map(repr, listed(s.chunk_table())))] for s in (store, lazy)],
        strict=True,
    ):
        assert one == other and one
    assert [lazy.log.runs.whole, lazy.log.versions.whole] == [not long] * 2, "a listing has read everything"
    for ask in (lambda s: s.grab("t").count(), lambda s: s.grab("t", variant="b").count(), lambda s: s.grab("t", as_of="2024-01-01 00:00:20").count(), lambda s: s.grab("log").count(), lambda s: s.grab("log", variant="a").count(), lambda s: s.grab("o"), lambda s: s.grab("log", run="all").count(), lambda s: s.sql("SELECT count(*) AS n FROM t JOIN log USING (id)").first().n, lambda s: s.is_stale(t.Label("b"))):
        assert ask(again(store)) == ask(store)
    assert lazy.grab("t", from_run=next(iter(store.log.runs))).count() == 1
    assert [lazy.log.runs.whole, lazy.log.versions.whole] == [not long] * 2, "a lookup has read everything"
    with pytest.raises(t.StoreError):
        lazy.grab("nothing")
    with pytest.raises(t.StoreError):
        lazy.grab("t", from_run="nothing")


def test_changes_on_a_written_state(store):
    """Rows that lie in the written state are touched, updated, picked up and pruned; other sessions see it."""
    history(store)
    lazy = again(store)
    lazy.stow(store.spark.range(2).withColumn("s", F.lit("x")), "t", shape="versioned")  # seen before
    queued = next(r["run_id"] for r in store.runs().where("status = 'queued'").collect())
    lazy.launch(t.Run(queued))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert lazy.prune("log", keep=1, force=True)["append"].first().rows_pruned == 2 + 3 + 4
        assert lazy.prune("t", keep=1)["versioned"].count() == 0
        assert lazy.prune("t", keep=1, force=True)["versioned"].count() == 3
        lazy.prune("o", keep_latest=True, force=True)
    fresh = again(store)
    store.log.replay()
    for s in (store, lazy, fresh):
        assert s.grab("q") == 1 and s.grab("log", run="all").count() == 5 and s.grab("o") == 2
        assert len(s.log.of_name("t")) == 1 and s.log.tables["log"]["row_count"] == 5
        assert s.runs().where(F.col("run_id") == queued).first().status == "success"
        assert s.versions("t").count() == 1
    assert fresh.log._state() == lazy.log._state()
    lazy.log.commit(lambda: [{"do": "run_update", "run_id": r.run_id, "set": {"os": "other"}} for r in lazy.runs().where("status = 'success'").collect()])
    assert again(store).runs().where("os = 'other'").count() == again(store).runs().where("status = 'success'").count() > 3
    store.log.replay()
    fresh = again(store)
    assert sorted(map(repr, listed(fresh.runs()))) == sorted(map(repr, listed(store.runs())))
    assert lazy.collect_garbage("0s") == [] or logs.WHOLE_ROWS == 0
    assert again(store).grab("log", run="all").count() == 5


def test_old_states_are_garbage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "WHOLE_ROWS", 0)
    monkeypatch.setattr(logs, "SNAPSHOT_EVERY", 3)
    store = t.Store(spark, str(tmp_path / "store"))
    for k in range(9):
        store.stow(k, "o")
    states = [x for x in store.files.names(store.log.folder) if x.endswith(".state")]
    assert len(states) == 3 and store.collect_garbage() == []
    assert sorted(store.collect_garbage("0s")) == [f"_log/{x}" for x in states[:2]]
    assert t.Store(spark, store.files.root).versions("o").count() == 9


def test_a_store_of_the_format_before(spark, tmp_path):
    """Format 1 recorded schemas that promised no nulls. They are brought up when they are read; the first commit raises the store's format."""
    store = t.Store(spark, str(tmp_path / "store"))
    store.stow(spark.sql("SELECT array(1) AS c"), "log")
    text = store.files.read(store.log._file(0)).decode()
    assert '"format": 2' in text and "containsNull" in text
    store.files.delete(store.log._file(0))
    store.files.create(store.log._file(0), text.replace('"format": 2', '"format": 1').replace('\\"containsNull\\":true', '\\"containsNull\\":false').encode())
    old = t.Store(spark, store.files.root)
    assert old.log.format == 1 and old.grab("log").first().c == [1] and '"containsNull":true' in old.log.tables["log"]["schema"]
    old.stow(1, "o")
    assert t.Store(spark, store.files.root).log.format == 2
