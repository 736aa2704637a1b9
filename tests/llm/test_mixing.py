import duckdb
import pytest

from tallyrun.llm import mixing

from .helpers import babble, docs, words


def naive_targets(sizes):
    """Share by weight; what stops at three times its size frees the rest to be shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_words_taken(spark, seed):
    sources = ["a", "b", None, "Z", "é", "zz"]
    rows = [(i, babble(i + 1000 * seed, (i * 7919) % 90 + 1 + 400 * (i % 97 == 0)), "en", sources[min(i % 11, 5)] if i % 3 else "a", 1) for i in range(900)]
    rows += [(900, None, "en", "empty", 0), (901, "", None, "empty", None), (None, "x y", "en", "a", 3), (902, "w " * 20000, "en", "b", 1)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, target, taken, most = {}, {}, {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
        most[r[3]] = max(most.get(r[3], 0), len(words(r[1])))
    for g in got:
        s = source[g.doc_id]
        assert g.source_size == sizes[s] and 0 <= g.copies <= 3 and g.taken == g.copies * g.size
        target[s], taken[s] = g.target, taken.get(s, 0) + g.taken
    want = naive_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 1.5 * most[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(7)).collect()), key=str)


def test_empty_table_one_source_and_clashing_columns(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    one = docs(spark, [(1, "a b c"), (2, None)]).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")
    got = {r.doc_id: r for r in mixing.mix(one).collect()}
    assert got[1].target == 3.0 and got[1].taken == 3 and got[2].taken == 0


def test_mixed_repeats_rows(spark):
    rows = [(i, babble(i, 30), "en", "abc"[i % 3], 5) for i in range(60)]
    table = docs(spark, rows)
    out = mixing.mixed(table)
    assert out.columns == table.columns
    assert out.count() == sum(r.copies for r in mixing.mix(table).collect())


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = mixing.op2_source_mixing(spark, folder)
    sql = con.sql(mixing.ORACLES["op2_source_mixing"])
    assert sorted(sql.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_mixed_takes_null_and_repeated_ids_as_rows(spark):
    rows = [(None if i % 4 == 0 else i // 3, babble(i, 30), "en", "abc"[i % 3], 5) for i in range(60)]
    rows += [rows[5]] * 3
    table = docs(spark, rows)
    wanted = mixing.mix(table).collect()
    out = mixing.mixed(table).collect()
    assert len(out) == sum(r.copies for r in wanted)
    assert sum(r.doc_id is None for r in out) == sum(r.copies for r in wanted if r.doc_id is None) > 0
    assert {tuple(r) for r in out} <= set(rows)
