"""Chunks of many runs in few files."""

import warnings
from datetime import date

import pytest
from pyspark.sql import functions as F

import tallyrun as t
from tallyrun.sources.datasource import StoreSource


@pytest.fixture
def store(spark, tmp_path):
    return t.Store(spark, str(tmp_path / "store"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def filled(store, n=12):
    """Runs with drift, labels, nested columns and a run of two chunks."""
    spark = store.spark
    ids = []
    for k in range(n):
        df = spark.range(k * 10, k * 10 + 3).selectExpr("id", f"'{'x' * (k * 20)}' AS s", f"DATE '2024-01-{k + 1:02d}' AS day", "array(named_struct('v', id)) AS l")
        if k >= n // 2:
            df = df.withColumn("more", F.lit(k / 2))

        def step(ctx, df=df, k=k):
            ctx.stow(df, "log")
            if k == 3:
                ctx.stow(df, "log")

        ids.append(store.launch(step, label=f"l{k % 3}", text=f"append {k}"))
    return ids


def seen(store, ids):
    out = {"all": rows(store.grab("log", run="all")), "latest": rows(store.grab("log")), "sql": rows(store.sql("SELECT variant_label, count(*), sum(id) FROM log GROUP BY 1")), "versions": rows(store.versions("log"))}
    return out | {i: rows(store.grab("log", run=i)) for i in ids} | {f"l{k}": rows(store.grab("log", variant=f"l{k}")) for k in range(3)}


def files(df):
    return df.inputFiles()


@pytest.mark.filterwarnings("ignore")
def test_every_read_is_as_before(spark, store):
    ids = filled(store)
    before = seen(store, ids)
    assert len(files(store.grab("log", run="all"))) >= 13
    assert store.compact("log", file_bytes=30_000) == 13
    assert seen(store, ids) == before == seen(t.Store(spark, store.files.root), ids)
    assert all("/pack=" in f for f in files(store.grab("log", run="all"))) and len(files(store.grab("log", run="all"))) < 8
    assert len(files(store.grab("log", run=ids[5]))) == 1
    assert store.compact("log") == 0
    spark.dataSource.register(StoreSource)
    read = lambda **o: rows(spark.read.format("tallyrun").options(store=store.files.root, table="log", **o).load())
    assert read(run="all") == before["all"] and read(run=ids[3]) == before[ids[3]]


@pytest.mark.filterwarnings("ignore")
def test_appends_prunes_and_garbage_after_packing(spark, store):
    ids = filled(store)
    before = seen(store, ids)
    store.compact("log", file_bytes=30_000)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        store.prune("log", run_id=ids[4], force=True)
    ids_left = [i for i in ids if i != ids[4]]
    gone = set(map(repr, before[ids[4]]))
    assert [r for r in before["all"] if repr(r[:-2]) not in gone] == rows(store.grab("log", run="all")) and store.grab("log", run=ids[4]).count() == 0
    new = [store.launch(lambda ctx, k=k: ctx.stow(spark.range(1000 + k, 1001 + k), "log"), text=f"later {k}") for k in range(3)]
    assert {i: rows(store.grab("log", run=i)) for i in ids_left} == {i: before[i] for i in ids_left}
    assert store.compact("log") == 3 and store.grab("log", run="all").where("id >= 1000").count() == 3
    assert len({c["pack"] for c in store.log.chunks}) == 2
    left = store.collect_garbage("0s")
    assert len([p for p in left if "/chunk=" in p]) == 13 - 1 + 3 and not any("/pack=" in p for p in left)
    assert rows(store.grab("log", run=new[1])) == [(1001, None, None, None, None)] and rows(store.grab("log", run=ids[0])) == before[ids[0]]
    store.prune("log", keep=0, force=True)
    assert store.grab("log", run="all").count() == 0 and len([p for p in store.collect_garbage("0s") if "/pack=" in p]) == 2


@pytest.mark.filterwarnings("ignore")
def test_ranges_skip_files(spark, store):
    ids = filled(store)
    everything = store.grab("log", run="all")
    for packed in (False, True):
        for between, condition in (({"id": (35, 52)}, "id between 35 and 52"), ({"day": (date(2024, 1, 5), None)}, "day >= '2024-01-05'"), ({"s": (None, "xxx")}, "s <= 'xxx'"), ({"more": (4.0, 4.5), "id": (None, 81)}, "more between 4 and 4.5 and id <= 81"), ({"id": (-5, -1)}, "false")):
            got = store.grab("log", run="all", between=between)
            assert rows(got) == rows(everything.where(condition)), between
            if packed and "id" in between:
                assert len(files(got)) < len(files(store.grab("log", run="all")))
        assert rows(store.grab("log", run=ids[2], between={"id": (21, None)})) == rows(store.grab("log", run=ids[2]).where("id >= 21"))
        if not packed:
            everything = spark.createDataFrame(everything.collect(), everything.schema)
            store.compact("log", file_bytes=20_000)
    for bad in ({"nothing": (1, 2)}, {"id": 3}):
        with pytest.raises(t.StoreError, match="between"):
            store.grab("log", between=bad)


@pytest.mark.filterwarnings("ignore")
def test_two_at_once_and_runs_under_way(spark, store):
    filled(store, 6)
    other = t.Store(spark, store.files.root)
    real = store.log.commit

    def late(build):
        store.log.commit = real
        assert other.compact("log") == 7
        real(build)

    store.log.commit = late
    before = rows(other.grab("log", run="all"))
    store.compact("log")
    assert rows(store.grab("log", run="all")) == before and len({c["pack"] for c in store.log.chunks}) == 1

    def step(ctx):
        ctx.stow(spark.range(1), "busy")
        ctx.stow(spark.range(2), "busy")
        assert ctx.store.compact("busy") == 0

    store.launch(step, text="busy")
    assert store.compact("busy") == 2
    with pytest.raises(t.StoreError):
        store.compact("nothing")
