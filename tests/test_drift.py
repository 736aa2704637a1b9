"""Nested and like-named columns of append tables."""

import json

import pytest
from pyspark.sql import types as T

import tallyrun as t
from tallyrun.names import StoreError
from tallyrun.operators import drift

PLAIN = [
    "array(1, 2) AS c",
    "split('a b', ' ') AS c",
    "named_struct('x', 1, 'y', array('p')) AS c",
    "map('k', 1, 'l', 2) AS c",
    "array(named_struct('m', map(1, array(2.5D)))) AS c",
    "array(1, CAST(NULL AS INT)) AS c",
    "CAST(NULL AS STRUCT<x: INT>) AS c",
    "map('k', CAST(NULL AS INT)) AS c",
    "array() AS c",
    "named_struct('x', NULL) AS c",
]


@pytest.fixture
def store(spark, tmp_path):
    return t.Store(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("column", PLAIN)
def test_nested_values_survive(spark, store, column):
    """Literals promise that nothing in them is null; what is read back does not."""
    df = spark.sql(f"SELECT 1 AS id, {column}")
    store.stow(df, "log")
    store.stow(df.withColumn("id", df.id + 1), "log")
    assert [r.c for r in store.grab("log", run="all").orderBy("id").collect()] == [df.first().c] * 2
    assert store.grab("log").first().c == df.first().c
    store.stow(df, "kept", shape="versioned")
    assert store.grab("kept").first().c == df.first().c


def test_collected_lists(spark, store):
    df = spark.range(10).selectExpr("id % 3 AS k", "id").groupBy("k").agg({"id": "collect_list"}).withColumnRenamed("collect_list(id)", "ids")
    store.stow(df, "lists")
    assert {r.k: sorted(r.ids) for r in store.grab("lists").collect()} == {0: [0, 3, 6, 9], 1: [1, 4, 7], 2: [2, 5, 8]}


def test_fields_come_go_and_differ(spark, store):
    """Only the field that differs becomes text, whatever it lies in."""
    store.stow(spark.sql("SELECT 1 AS id, named_struct('a', 1, 'b', 'x') AS s, array(named_struct('v', 1, 'w', 2)) AS l, map('k', named_struct('n', 1)) AS m"), "log")
    with pytest.warns(UserWarning) as said:
        store.stow(spark.sql("SELECT 2 AS id, named_struct('b', 'y', 'c', true) AS s, array(named_struct('v', 'one')) AS l, map(7, named_struct('n', 2.5D)) AS m"), "log")
    assert any("s.c" in str(w.message) for w in said) and any("l[].v" in str(w.message) and "m{key}" not in str(w.message) and "m{value}.n" in str(w.message) for w in said)
    store.stow(spark.sql("SELECT 3 AS id, CAST(NULL AS STRUCT<a: INT>) AS s"), "log")
    got = {r.id: r.asDict(recursive=True) for r in store.grab("log", run="all").collect()}
    assert got[1]["s"] == {"a": 1, "b": "x", "c": None} and got[2]["s"] == {"a": None, "b": "y", "c": True} and got[3]["s"] is None
    assert got[1]["l"] == [{"v": "1", "w": 2}] and got[2]["l"] == [{"v": "one", "w": None}] and got[3]["l"] is None
    assert got[1]["m"] == {"k": {"n": "1"}} and got[2]["m"] == {"7": {"n": "2.5"}} and got[3]["m"] is None
    assert store.grab("log").columns == ["id", "s", "l", "m"]


def test_nested_beside_plain_becomes_text(spark, store):
    store.stow(spark.sql("SELECT 1 AS id, array(1, NULL) AS c"), "log")
    with pytest.warns(UserWarning, match="become text"):
        store.stow(spark.sql("SELECT 2 AS id, 5 AS c"), "log")
    assert {r.id: r.c for r in store.grab("log", run="all").collect()} == {1: "[1,null]", 2: "5"}


def test_numbers_widen_within(spark, tmp_path):
    store = t.Store(spark, str(tmp_path / "store"), widen_numbers=True)
    store.stow(spark.sql("SELECT named_struct('a', array(1)) AS s"), "log")
    store.stow(spark.sql("SELECT named_struct('a', array(5000000000)) AS s"), "log")
    assert sorted(r.s.a[0] for r in store.grab("log", run="all").collect()) == [1, 5000000000]


def test_names_that_differ_in_case_are_one_column(spark, store):
    store.stow(spark.sql("SELECT 1 AS a, named_struct('x', 1) AS s"), "log")
    store.stow(spark.sql("SELECT 2 AS A, named_struct('X', 2) AS S"), "log")
    store.stow(spark.sql("SELECT 3 AS a"), "log")
    out = store.grab("log", run="all")
    assert out.columns[:2] == ["a", "s"] and sorted((r.a, r.s and r.s.x) for r in out.collect()) == [(1, 1), (2, 2), (3, None)]
    assert store.grab("log").collect() == spark.sql("SELECT 3 AS a, CAST(NULL AS STRUCT<x: INT>) AS s").collect()


def test_names_in_exact_case(spark, store):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        store.stow(spark.sql("SELECT 1 AS a"), "log")
        store.stow(spark.sql("SELECT 2 AS A"), "log")
        assert sorted(map(repr, map(tuple, store.grab("log", run="all").select("a", "A").collect()))) == ["(1, None)", "(None, 2)"]
        both = spark.sql("SELECT 1 AS b, 2 AS B")
        store.stow(both, "two")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    with pytest.raises(StoreError, match="one name"):
        store.stow(both, "three")
    with pytest.raises(StoreError, match="one name"):
        store.stow(spark.sql("SELECT named_struct('q', 1, 'Q', 2) AS s"), "three")
    assert store.files.names(store.files.path("data", "three")) == []


def test_stores_of_before_are_read(spark, store):
    """Schemas that promise no nulls, and columns recorded twice in other case, are mended when they are read."""
    store.stow(spark.sql("SELECT 1 AS a, array(1) AS c"), "log")
    store.stow(spark.sql("SELECT 2 AS a, array(2) AS c"), "log")
    strict = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("c", T.ArrayType(T.IntegerType(), False)), T.StructField("A", T.IntegerType())])
    store.log.tables["log"]["schema"] = strict.json()
    store.log.chunks[0]["schema"] = T.StructType(strict.fields[:2]).json()
    store.log.chunks[1]["schema"] = T.StructType([strict.fields[2], strict.fields[1]]).json()
    assert sorted((r.a, r.c) for r in store.grab("log", run="all").collect()) == [(1, [1]), (2, [2])]
    store.stow(spark.sql("SELECT 3 AS A, array(CAST(NULL AS INT)) AS c"), "log")
    assert sorted((r.a, r.c) for r in store.grab("log", run="all").collect()) == [(1, [1]), (2, [2]), (3, [None])]
    assert json.loads(store.log.tables["log"]["schema"])["fields"][0]["name"] == "a"


def test_reconciled_schemas_are_their_own_fixpoint():
    a = T.StructType.fromDDL("id int, s struct<a: int, b: array<string>>, m map<string, struct<x: long>>")
    b = T.StructType.fromDDL("id string, s struct<b: array<int>, c: date>, m map<string, struct<x: long, y: int>>, e int")
    first = drift.reconcile(a, b)
    assert first.added == ["s.c", "m{value}.y", "e"] and first.missing == ["s.a"] and first.texts == ["id"]
    again = drift.reconcile(first.schema, first.schema)
    assert again.schema == first.schema and not (again.added or again.missing or again.texts)
