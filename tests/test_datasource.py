"""The store as a data source, published views, names that are dropped."""

import pytest
from pyspark.sql import functions as F

import tallyrun as t
from tallyrun import log as logs
from tallyrun.sources.datasource import StoreSource


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(StoreSource)
    return t.Store(spark, str(tmp_path / "store"))


def read(store, table, **options):
    return store.spark.read.format("tallyrun").options(path=store.files.root, table=table, **options).load()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("whole", [0, 10**9])
def test_reads_what_grab_reads(spark, store, monkeypatch, whole):
    monkeypatch.setattr(logs, "WHOLE_ROWS", whole)
    monkeypatch.setattr(logs, "SNAPSHOT_EVERY", 3)
    make = lambda n: spark.range(n).selectExpr("id", "CAST(id AS STRING) AS s", "id / 2 AS d", "DATE '2024-01-01' AS day", "TIMESTAMP_NTZ '2024-01-01 10:00:00' AS at", "CAST(id AS DECIMAL(10, 2)) AS m", "array(named_struct('x', id)) AS l", "map('k', id) AS p")
    for n, label in ((3, "a"), (5, "b"), (4, "a")):
        store.launch(lambda ctx, n=n: ctx.stow(make(n), "t", shape="versioned"), label=label, text=f"t{n}")
        store.launch(lambda ctx, n=n: ctx.stow(make(n), "log"), label=label, text=f"l{n}")
    first = store.log.of_name("t")[0]
    for options in ({}, {"version": first["content_hash"]}, {"variant": "b"}, {"as_of": first["first_seen"]}, {"from_run": next(iter(store.log.runs))}):
        assert read(store, "t", **options).schema == store.grab("t", **options).schema and rows(read(store, "t", **options)) == rows(store.grab("t", **options))
    for options in ({}, {"run": "all"}, {"variant": "b"}, {"run": store.log.chunks[0]["run_id"]}):
        assert rows(read(store, "log", **options)) == rows(store.grab("log", **options)), options
    assert read(store, "t").rdd.getNumPartitions() >= 1


def test_missing_columns_and_other_types(spark, store):
    store.stow(spark.sql("SELECT 1 AS a"), "log")
    store.stow(spark.sql("SELECT 2 AS A, 'x' AS b"), "log")
    assert sorted(rows(read(store, "log", run="all").select("a", "b"))) == [(1, None), (2, "x")]
    with pytest.warns(UserWarning):
        store.stow(spark.sql("SELECT 'three' AS a"), "log")
    assert rows(read(store, "log").select("a")) == [("three",)]
    with pytest.raises(Exception, match="grab"):
        read(store, "log", run="all").collect()


def test_queries_over_one_relation(spark, store):
    """With filters that could be pushed and others that could not, also where pushing is allowed."""
    store.stow(spark.range(1000).selectExpr("id", "IF(id % 2 = 0, NULL, id) AS odd", "CAST(id AS STRING) AS s"), "t", shape="versioned")
    for allowed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", allowed)
        df = read(store, "t")
        assert rows(df.where("id > 990 AND s <> '995' AND odd IS NOT NULL").select("id")) == [(991,), (993,), (997,), (999,)]
        assert df.where("id IN (3, 5) OR s = '7'").count() == 3 and df.where("id = 5 AND odd <= 5").count() == 1 and df.where("NOT id >= 2").count() == 2
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_what_is_refused(spark, store):
    store.stow(1, "o")
    store.stow(spark.range(2), "t", shape="versioned")
    store.stow(t.Sql("SELECT * FROM t"), "v", shape="view")
    for options, why in (({"table": "nothing"}, "nothing"), ({"table": "o"}, "artifact"), ({"table": "v"}, "view"), ({"table": "t", "run": "all"}, "from_run"), ({"table": "t", "version": "a", "variant": "b"}, "choose one")):
        with pytest.raises(Exception, match=why):
            spark.read.format("tallyrun").options(path=store.files.root, **options).load().collect()


def test_published_views(spark, store):
    store.stow(spark.range(3), "pub_t", shape="versioned")
    store.stow(spark.range(2), "pub_log")
    store.stow(t.Sql("SELECT count(*) AS n FROM pub_t"), "pub_v", shape="view")
    store.stow("text", "pub_o")
    try:
        assert store.publish() == ["pub_log", "pub_t", "pub_v"] and store.publish("pub_log", prefix="my_") == ["my_pub_log"]
        count = lambda name: spark.sql(f"SELECT count(*) AS n FROM {name}").first().n
        assert (count("pub_t"), count("my_pub_log"), spark.sql("SELECT n FROM pub_v").first().n) == (3, 2, 3)
        store.stow(spark.range(7), "pub_t", shape="versioned")
        store.launch(lambda ctx: ctx.stow(spark.range(5), "pub_log"), text="a step's commits show as well")
        assert (count("pub_t"), count("my_pub_log")) == (7, 7)
        t.Store(spark, store.files.root).stow(spark.range(9), "pub_t", shape="versioned")  # another process
        assert read(store, "pub_t").count() == 9
        store.publish("pub_t")
        assert count("pub_t") == 9
    finally:
        for v in ("pub_t", "pub_log", "my_pub_log", "pub_v"):
            spark.catalog.dropTempView(v)


def test_names_are_dropped(spark, store):
    assert not store.exists("t")
    store.stow(spark.range(3), "t", shape="versioned")
    store.launch(lambda ctx: ctx.stow(spark.range(4), "made", shape="versioned"), text="made")
    store.launch(lambda ctx: ctx.stow(spark.range(4), "log"), label="x", text="log")
    assert store.exists("t") and store.exists("log")
    store.drop("t")
    for name in ("made", "log"):
        with pytest.raises(t.StoreError, match="force"):
            store.drop(name)
        store.drop(name, force=True)
    again = t.Store(spark, store.files.root)
    for s in (store, again):
        assert not any(s.exists(n) for n in ("t", "made", "log")) and s.runs().count() == 3
    with pytest.raises(t.StoreError, match="nothing"):
        store.drop("t")
    store.stow(spark.range(2).withColumn("k", F.lit("free for another shape")), "t")
    assert again.grab("t").count() == 2 and store.files.names(store.files.path("data", "log")) == []
