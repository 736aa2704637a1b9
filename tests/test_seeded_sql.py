import pytest
from pyspark.sql import functions as F

import tallyrun as t
from tallyrun.functions.hashing import table_digest
from tallyrun.operators.sampling import dealt

HEADER = "-- @inputs: a\n-- @output: r\n"


@pytest.fixture
def store(spark, tmp_path):
    store = t.Store(spark, str(tmp_path / "store"))
    store.stow(spark.range(200).repartition(4), "a", shape="versioned")
    return store


@pytest.mark.parametrize(
    "body",
    [
        "SELECT * FROM a TABLESAMPLE (10 PERCENT)",
        "WITH s AS (SELECT * FROM a TABLESAMPLE (50 PERCENT)) SELECT count(*) AS n FROM s",
        "SELECT * FROM a WHERE id IN (SELECT id FROM a TABLESAMPLE (10 PERCENT))",
        "SELECT id, current_timestamp() AS x FROM a",
        "SELECT id FROM a WHERE current_date() > DATE '2020-01-01'",
        "SELECT id, now() AS x FROM a",
        "SELECT id, unix_timestamp() AS x FROM a",
        "SELECT id, localtimestamp() AS x FROM a",
        "SELECT id, monotonically_increasing_id() AS x FROM a",
        "SELECT id, spark_partition_id() AS x FROM a",
        "SELECT id, input_file_name() AS x FROM a",
        "SELECT id, uuid() AS x FROM a",
        "SELECT max(x) AS x FROM (SELECT shuffle(array(id, 2, 3)) AS x FROM a)",
        "SELECT id, (SELECT max(y) FROM (SELECT monotonically_increasing_id() AS y FROM a)) AS x FROM a",
        "SELECT id FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE b.id = a.id AND b.id > 1) AND id < (SELECT count(current_timestamp()) FROM a)",
        "WITH c AS (SELECT id, uuid() AS u FROM a) SELECT * FROM c JOIN c d USING (id)",
    ],
)
def test_chance_that_a_seed_does_not_govern_is_refused(store, body):
    with pytest.raises(t.StoreError, match="seeded SQL step"):
        store.launch(t.Sql(HEADER + body), materialize=True, seed=0.5)
    assert store.log.shape("r") is None
    if "USING" not in body and "uuid" not in body:
        store.launch(t.Sql(HEADER + body), materialize=True)  # without a seed all is allowed


@pytest.mark.parametrize(
    "body",
    [
        "SELECT id, rand() AS x, randn() AS y FROM a",
        "SELECT * FROM a TABLESAMPLE (50 PERCENT) REPEATABLE (7)",
        "SELECT id, current_user() IS NULL AS x, date_trunc('day', TIMESTAMP '2024-01-01 10:00:00') AS d FROM a WHERE id IN (SELECT id FROM a WHERE rand() < 0.5)",
        "SELECT first(id) AS f, collect_list(id) AS l, row_number() OVER (ORDER BY max(id)) AS n FROM a",
    ],
)
def test_what_it_governs_is_the_same_again(spark, store, body):
    for _ in range(2):
        store.launch(t.Sql(HEADER + body), materialize=True, seed=0.5, force=True)
    if "first(" not in body:
        assert len(store.log.of_name("r")) == 1
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            store.launch(t.Sql(HEADER + body), materialize=True, seed=0.5, force=True)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(store.log.of_name("r")) == 1


def drawn(spark, folder, rows, body):
    store = t.Store(spark, str(folder))
    store.stow(rows, "a", shape="versioned")
    store.launch(t.Sql(HEADER + body), materialize=True, seed=0.5)
    return sorted(map(tuple, store.grab("r").collect()))


@pytest.mark.parametrize(
    "body",
    [
        "SELECT id, rand() AS x, randn() AS y FROM a WHERE id % 3 > 0",
        "SELECT * FROM a TABLESAMPLE (50 PERCENT) REPEATABLE (7)",
        "WITH s AS (SELECT id, rand() AS x FROM a) SELECT s.id, s.x, o.x AS o FROM s JOIN s o ON o.id = s.id + 1",
        "SELECT id FROM a ORDER BY rand() LIMIT 20",
        "SELECT k, max(x) AS x, count(*) AS n FROM (SELECT id % 5 AS k, rand() AS x FROM a) GROUP BY k",
        "SELECT floor(rand() * 3) AS k, count(*) AS n, sum(id) AS s FROM a GROUP BY 1",
        "SELECT id, row_number() OVER (ORDER BY rand()) AS x FROM a WHERE rand() < 0.9",
        "SELECT count(*) AS n, rand() AS x FROM a",
    ],
)
def test_rows_in_other_files_draw_the_same_numbers(spark, tmp_path, monkeypatch, body):
    """Numbers go by what rows hold, not by how many files they lie in and in which order."""
    monkeypatch.setattr("tallyrun.operators.sampling.DEAL_ROWS", 60)
    few = drawn(spark, tmp_path / "few", spark.range(400).selectExpr("id", "IF(id % 7 = 0, NULL, id) AS v").coalesce(1), body)
    assert few == drawn(spark, tmp_path / "many", spark.range(400).selectExpr("id", "IF(id % 7 = 0, NULL, id) AS v").orderBy((-F.col("id")) % 11).repartition(9), body)
    assert few


def test_equal_rows_are_dealt_apart_and_none_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyrun.operators.sampling.DEAL_ROWS", 50)
    monkeypatch.setattr("tallyrun.operators.sampling.DEAL_COPIES", 30)
    rows = spark.range(500).selectExpr("IF(id < 401, 'much', concat('few', id)) AS s", "IF(id < 401, NULL, map('k', id)) AS m", "CAST('NaN' AS DOUBLE) AS `_block`")
    out = dealt(rows.repartition(7))
    assert out.dtypes == rows.dtypes and table_digest(out) == table_digest(rows)
    sizes = [r[1] for r in out.where("s = 'much'").groupBy(F.spark_partition_id()).agg(F.count("*")).collect()]
    assert sum(sizes) == 401 and max(sizes) < 200
    body = "SELECT s, rand() AS x FROM a"
    one = drawn(spark, tmp_path / "one", rows.coalesce(1), body)
    assert len(set(one)) == 500 and one == drawn(spark, tmp_path / "two", rows.repartition(6), body)
    assert dealt(rows.limit(0)).count() == 0 and dealt(rows.select()).count() == 500


@pytest.mark.parametrize(
    "body",
    [
        "SELECT a.id, rand() AS x FROM a JOIN a b USING (id)",
        "SELECT id % 3 AS k, count(*) AS n, rand() AS x FROM a GROUP BY 1",
        "SELECT * FROM (SELECT DISTINCT id % 9 AS k FROM a) WHERE rand() < 0.5",
        "SELECT id, rand() AS x FROM a WHERE id IN (SELECT id + 1 FROM a)",
        "SELECT id, rand() AS x FROM (SELECT id, lag(id) OVER (ORDER BY id) AS l FROM a)",
        "WITH s AS (SELECT id, rand() AS x FROM a) SELECT s.id, rand() AS y FROM s UNION ALL SELECT id, x FROM s",
        "SELECT * FROM (SELECT id FROM a LIMIT 50) TABLESAMPLE (50 PERCENT) REPEATABLE (7)",
        "SELECT /*+ REPARTITION(3) */ id FROM a WHERE EXISTS (SELECT 1 FROM (SELECT /*+ REPARTITION(3) */ id FROM a) WHERE rand() < 0.1)",
    ],
)
def test_chance_above_a_shuffle_is_refused(store, body):
    with pytest.raises(t.StoreError, match="seeded SQL step can't draw"):
        store.launch(t.Sql(HEADER + body), materialize=True, seed=0.5)
    assert store.log.shape("r") is None
    store.launch(t.Sql(HEADER + body), materialize=True)  # without a seed all is allowed


def test_draws_over_a_stored_view_that_draws_and_names_in_any_case(spark, tmp_path):
    def run(folder, rows):
        store = t.Store(spark, str(folder))
        store.stow(rows, "Firm", shape="versioned")
        store.launch(t.Sql("-- @inputs: Firm\n-- @output: v\nSELECT id, rand() AS x FROM firm"), seed=0.5)
        store.launch(t.Sql("-- @inputs: v, Firm\n-- @output: r\nSELECT y.id, x, y FROM (SELECT id, x, rand() AS y FROM v) y JOIN FIRM f ON f.id = y.id"), materialize=True, seed=0.25)
        return sorted(map(tuple, store.grab("r").collect()))

    one = run(tmp_path / "one", spark.range(300).coalesce(1))
    assert len(one) == 300 and one == run(tmp_path / "two", spark.range(300).orderBy(F.col("id") % 7).repartition(5))
