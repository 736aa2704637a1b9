import math

import duckdb
import numpy as np
import pytest

from tallyrun.llm import topk


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), d) for d, b in good if d != q and len(a) == len(b))
            out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("superblock,pack", [(8192, 2048), (40, 3)])
def test_matches_brute_force(spark, superblock, pack):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 420)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [math.nan] * 6), (600, [math.inf] * 6), (None, rows[1][1]), (650, [0.0] * 6), (-50, rows[3][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.top_k(table, lambda i: i % 50 == 0, superblock=superblock, pack=pack)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_rows_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), lambda i: i % 50 == 0).collect() == []
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [-1.0, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, schema), lambda i: i % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_products_past_float_precision():
    q, d = np.array([[float(2**40), 1.0]]), np.array([[float(2**20), 3.0], [float(2**60), 0.0]])
    assert topk.products(q, d).tolist() == [[2**60 + 3, 2**63 - 1]]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = topk.op9_topk_search(spark, folder)
    sql = con.sql(topk.ORACLES["op9_topk_search"])
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_only_pairs_that_bounds_leave_are_moved(spark, monkeypatch):
    """Vectors of a superblock lie around one axis, so nearly all of its pairs with other queries are pruned before vectors move."""
    r = np.random.default_rng(2)
    rows = [(k, (np.eye(16)[k // 100] * 4 + r.uniform(0, 0.2, 16)).tolist()) for k in range(1600)]
    moved = []
    real = topk.scored
    monkeypatch.setattr(topk, "scored", lambda pairs, *a: moved.append(pairs.count()) or real(pairs, *a))
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0, superblock=100).collect()))
    q = topk.integers([v for _, v in rows])
    scores = (q @ q.T).astype(np.int64)
    want = []
    for i in range(0, 1600, 10):
        best = sorted((-int(scores[i, j]), j) for j in range(1600) if j != i)[:5]
        want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(best)]
    assert got == sorted(want)
    assert moved[0] == 160 and moved[1] <= 160  # of 160 * 16 pairs
