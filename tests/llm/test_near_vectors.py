import math

import duckdb
import numpy as np
import pytest

from tallyrun.llm import near_vectors
from tests.llm.helpers import roots


def brute(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]

    def linked(i, j):
        a, b = rows[i][1], rows[j][1]
        if not (good[i] and good[j] and len(a) == len(b)):
            return False
        a, b = (np.array(x, float) / max(map(abs, x)) for x in (a, b))
        return (a @ b) / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j)]
    root, n = roots(len(rows), pairs), [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return sorted([(i, n[k], least.get(root[k]), i is not None and least[root[k]] == i) for k, (i, _) in enumerate(rows)], key=repr)


def found(spark, rows, **options):
    kind = "vec_id long, embedding array<double>, label int, v int, key string, node long"
    table = spark.createDataFrame([(i, v, 1, 2, "k", 3) for i, v in rows], kind).repartition(3)
    return sorted((tuple(r) for r in near_vectors.near_vectors(table, **options).collect()), key=repr)


def clustered(seed, n, dim, spread):
    """Groups of near vectors of all sizes, some at the threshold, chains, copies and multiples, and vectors near nothing."""
    r = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c = r.normal(size=dim)
        for _ in range(int(r.choice([1, 2, 3, 20]))):
            rows.append((len(rows), (c + spread * r.uniform(0.3, 1.2) * r.normal(size=dim)).tolist()))
    rows += [(len(rows) + k, rows[5][1]) for k in range(30)]
    rows += [(len(rows) + k, [x * (k + 2) for x in rows[9][1]]) for k in range(3)]
    return rows


ODD = [(None, [1.0, 0.0]), (None, [1.0, 0.1]), (-5, [1.0, 0.01]), (-5, [1.0, 0.01]), (-5, [-3.0, 0.0]), (-4, None), (-3, []), (-2, [0.0, -0.0]), (-1, [None, 1.0]), (-6, [math.nan, 1.0]), (-7, [math.inf, 1.0]), (-8, [1e300, 1e300]), (-9, [1e-200, 1.1e-200]), (-10, [0.0, 5.0]), (-11, [-0.0, 5.0]), (None, [7.0, 7.0, 7.0])]


@pytest.mark.parametrize("dim,tile,rows", [(40, 1024, 2048), (40, 8, 23), (5, 16, 50)])
def test_matches_brute_force(spark, dim, tile, rows):
    """Small tiles and strips, so that all kinds of pairs of these are met."""
    table = clustered(dim, 300, dim, 0.3) + ODD
    want = brute(table)
    assert found(spark, table, tile=tile, strip_rows=rows) == want
    assert max(w[1] for w in want) >= 30 and any(w[1] and not w[3] for w in want)


def test_other_thresholds(spark):
    table = clustered(3, 150, 70, 0.5)
    for threshold in (0.5, 0.97):
        assert found(spark, table, threshold=threshold, strip_rows=40, tile=10) == brute(table, threshold)
    with pytest.raises(ValueError):
        near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), threshold=0)


def test_bounded_strips(spark):
    """Few bytes a strip make more strips than STRIPS."""
    table = clustered(4, 200, 20, 0.3)
    assert found(spark, table, strip_bytes=20 * 8 * 15, strip_rows=1) == brute(table)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_exactly_at_the_threshold(spark):
    """0.6 * 0.6 + 0.8 * 0.8 and the like: pairs within the margin are decided by the vectors as given."""
    table = [(k, [float(np.cos(t)), float(np.sin(t))]) for k, t in enumerate(np.arange(60) * math.acos(0.9))]
    x = np.array([v for _, v in table])
    hits = near_vectors.cosines(x[:-1], x[1:]) >= 0.9
    got = found(spark, table)
    assert sum(r[1] for r in got) >= 2 * hits.sum() and hits.any() and not hits.all()
    i, j = np.triu_indices(60, 1)
    assert sum(r[1] for r in got) == 2 * (near_vectors.cosines(x[i], x[j]) >= 0.9).sum()


def test_tiles_and_first_components_prune():
    """Of vectors about a few axes most tiles never meet, and most pairs that meet go after the first components."""
    r = np.random.default_rng(1)
    x = np.repeat(np.eye(32)[:8], 100, axis=0) + 0.02 * r.normal(size=(800, 32))
    side = near_vectors.Side(np.arange(800), np.ones(800, int), x, None, 100)
    gaps = np.array([[(np.maximum(0, np.maximum(side.low[p] - side.high[q], side.low[q] - side.high[p])) ** 2).sum() for q in range(8)] for p in range(8)])
    assert (gaps <= 0.2).sum() == 8
    assert sorted(map(len, (np.unique(side.y[t].argmax(axis=1)) for t in side.tiles))) == [1] * 8


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = near_vectors.op13_near_vectors(spark, folder)
    sql = con.sql(near_vectors.ORACLES["op13_near_vectors"])
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())
