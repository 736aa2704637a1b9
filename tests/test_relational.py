"""As-of lookups with heavy keys, names that clash, exact shares."""

import random

import pytest
from pyspark.sql import functions as F

from tallyrun.operators.relational import SPLIT_PARTS, _before, as_of, keep_first, newest_per_group, older_per_group


def brute(left, right):
    out = []
    for k, t, x in left:
        best = max(((rt, -1 if tie is None else tie, v) for rk, rt, tie, v in right if None not in (k, t, rt) and rk == k and rt <= t), default=None, key=lambda r: r[:2])
        out.append((k, t, x, best[2] if best else None))
    return sorted(out, key=repr)


def tables(seed, n, heavy):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < heavy else r.choice(["a", "b", None])
    left = [(key(), r.choice([None, *range(60)] if k % 9 == 0 else range(2000)), k) for k in range(n)]
    right = [(key(), r.choice([None, 7] if k % 11 == 0 else range(2000)), k, f"v{k}") for k in range(n // 2)]
    return left, right


@pytest.mark.parametrize("split", [10**6, 50, 1])
def test_as_of_splits_heavy_keys(spark, split):
    left, right = tables(split, 900, 0.6)
    a, b = spark.createDataFrame(left, "k string, t int, x int"), spark.createDataFrame(right, "k string, t int, tie int, v string")
    got = as_of(a.repartition(5), b.repartition(3), ["k"], "t", "t", "tie", ["v"], split_rows=split)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right)


def test_a_heavy_key_is_the_work_of_many_tasks(spark):
    """A third of a million rows of one key: no window partition has much more than the rows asked for."""
    left = spark.range(200_000).selectExpr("IF(id % 10 < 9, 1, id) AS k", "id AS t")
    right = spark.range(100_000).selectExpr("IF(id % 10 < 9, 1, id) AS k", "id * 2 AS t", "id AS tie")
    out = as_of(left, right, ["k"], "t", "t", "tie", ["tie"], split_rows=20_000)
    plain = as_of(left, right, ["k"], "t", "t", "tie", ["tie"])
    assert out.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.count("*")).first() == plain.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.count("*")).first()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("t > 10 and k = 1 and tie is null").isEmpty()


def test_no_row_that_is_sorted_or_grouped_holds_the_cuts(spark):
    """With a thousand cuts in every row, memory grew as rows times ranges."""
    left = spark.range(3000).selectExpr("id % 2 AS k", "id AS t")
    right = spark.range(3000).selectExpr("id % 2 AS k", "id AS t", "id AS tie")
    out = as_of(left, right, ["k"], "t", "t", "tie", ["tie"], split_rows=20)
    assert out.where("tie = t").count() == 3000
    seen = []

    def walk(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in ("Aggregate", "Window", "Sort"):
            seen.append(node.nodeName())
            for c in children:
                kinds = [c.output().apply(i).dataType().simpleString() for i in range(c.output().size())]
                assert not [k for k in kinds if k.startswith("array")]
        for c in children:
            walk(c)

    walk(out._jdf.queryExecution().optimizedPlan())
    assert {"Aggregate", "Window"} <= set(seen)


def test_ranges_are_found_by_halving(spark):
    r = random.Random(4)
    rows = [(r.choice([None, r.randrange(-5, 60)]), r.choice([None, sorted(r.sample(range(50), n))])) for n in (0, 1, 2, 3, 31, 32, 50) for _ in range(40)]
    rows += [(v, list(range(0, 2 * (SPLIT_PARTS - 1), 2))) for v in (-1, 0, 1, 1023, 1024, 1995, 1996, 1997, 5000)]
    got = spark.createDataFrame(rows, "v int, a array<int>").select("v", "a", _before(F.col("v"), F.col("a")).alias("n")).collect()
    assert len(got) == len(rows) and all(n == (0 if v is None or a is None else sum(x < v for x in a)) for v, a, n in got)


def test_ranges_without_right_rows_are_seeded(spark):
    left = [("a", t, t) for t in range(0, 1000)]
    right = [("a", 3, 1, "early"), ("a", 990, 1, "late"), ("a", 990, None, "lost")]
    a, b = spark.createDataFrame(left, "k string, t int, x int"), spark.createDataFrame(right, "k string, t int, tie int, v string")
    got = as_of(a, b, ["k"], "t", "t", "tie", ["v"], split_rows=40)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right)


def test_names_that_clash(spark):
    names = ["_t", "side", "row", "k0", "a.b", "seen"]
    left = spark.createDataFrame([(1, 5, 1, 2, 3, 4)], "`_t` int, side int, `row` int, k0 int, `a.b` int, seen int")
    right = spark.createDataFrame([(1, 4, 7, 8), (1, 6, 9, 10)], "`_t` int, side int, `a.b` int, tie int")
    got = as_of(left, right, ["_t"], "side", "side", "tie", ["a.b", "side"])
    assert got.columns == [*names, "a.b", "side"] and tuple(got.first()) == (1, 5, 1, 2, 3, 4, 7, 4)
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "k int, `_place` int, `_rank` int")
    assert sorted(map(tuple, newest_per_group(df, ["k"], ["_place"]).collect())) == [(1, 2, 6), (2, 1, 7)]
    assert sorted(map(tuple, older_per_group(df, ["k"], ["_place"]).collect())) == [(1, 1, 5)]
    assert sorted(map(tuple, keep_first(df, ["k"], ["_rank"]).collect())) == [(1, 1, 5), (2, 1, 7)]


def test_empty_sides(spark):
    a, b = spark.createDataFrame([], "k int, t int"), spark.createDataFrame([], "k int, t int, v int")
    assert as_of(a, b, ["k"], "t", "t", "v", ["v"]).collect() == []
    assert [tuple(r) for r in as_of(spark.createDataFrame([(1, 1)], "k int, t int"), b, ["k"], "t", "t", "v", ["v"]).collect()] == [(1, 1, None)]
