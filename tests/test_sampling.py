import pytest
from pyspark.sql import functions as F

from tallyrun.operators.sampling import percent_sample


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("percent", [0, 0.05, 1, 20, 33.3, 50, 99.9, 100])
def test_exact_and_stable(spark, percent):
    df = spark.range(1999).withColumn("x", F.col("id") % 7)
    got = percent_sample(df, percent, 0.25, ["id"])
    assert got.count() == int(1999 * percent / 100 + 0.5)
    assert rows(got) == rows(percent_sample(df.repartition(7, "x"), percent, 0.25, ["id"]))
    assert set(rows(got)) <= set(rows(percent_sample(df, min(100, percent + 5), 0.25, ["id"]))), "a larger share has the smaller one's rows"
    if 0 < percent < 100:
        assert rows(got) != rows(percent_sample(df, percent, 0.5, ["id"])) and got.columns == ["id", "x"]


def test_keys_and_rows_that_repeat(spark):
    """A key with half of the rows, many of them the same as each other: still exact, and the same rows however they lie."""
    df = spark.range(1000).selectExpr("IF(id < 500, 7, id) AS k", "IF(id < 400, 'same', CAST(id AS STRING)) AS v", "map('a', id < 400) AS m", "array(id % 2) AS _hash")
    for percent in (1, 25, 40, 55, 60, 90):
        got = percent_sample(df, percent, 0.1, ["k"])
        assert got.count() == percent * 10 and rows(got) == rows(percent_sample(df.repartition(5), percent, 0.1, ["k"]))
        assert rows(percent_sample(df, percent, 0.1)) == rows(percent_sample(df.coalesce(1), percent, 0.1))
    assert percent_sample(df.where("k = 7 AND v = 'same'").drop("_hash"), 25, 0.3).count() == 100


def test_nothing(spark):
    df = spark.createDataFrame([], "a int, b map<string, int>")
    assert percent_sample(df, 50, 0.1).collect() == [] == percent_sample(df, 100, 0.1, ["a"]).collect()
    assert percent_sample(spark.createDataFrame([(None,)], "a int"), 50, 0.1).count() == 1
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            percent_sample(df, bad, 0.1)
