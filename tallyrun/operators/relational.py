"""Relational operators that the engine's own queries are made of, as compositions of built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import quoted


#: Rows of a key from which an as-of lookup splits it, and how many keys, and parts of one, it splits at most.
SPLIT_ROWS, SPLIT_KEYS, SPLIT_PARTS = 1_000_000, 1000, 1000


def _free(df: DataFrame, name: str) -> str:
    """A column name that a frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[F.Column], keeps) -> DataFrame:
    place = _free(df, "_place")
    w = W.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(keeps(F.col(place))).drop(place)


def newest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: int = 1) -> DataFrame:
    """The last ``keep`` rows of each group by ``order`` (nulls first, so never newest). Null keys are a group."""
    return _placed(df, keys, [F.col(quoted(c)).desc_nulls_last() for c in order], lambda place: place <= keep)


def older_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: int = 1) -> DataFrame:
    """What newest_per_group leaves out: the rows that pruning to ``keep`` would remove."""
    return _placed(df, keys, [F.col(quoted(c)).desc_nulls_last() for c in order], lambda place: place > keep)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[F.Column | str]) -> DataFrame:
    """One row per key, the first by ``order`` (which dropDuplicates doesn't promise)."""
    return _placed(df, keys, [F.col(quoted(c)) if isinstance(c, str) else c for c in order], lambda place: place == 1)


def with_any(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among ids (a semi-join)."""
    return df.join(ids, on, "left_semi")


def without_any(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not among ids (an anti-join)."""
    return df.join(ids, on, "left_anti")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tie: str, columns: Sequence[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """For every left row the last right row of the same ``by`` at or before its time, with ``columns`` of it (null if there is none).

    Both sides are put on one time line per key and the last right row so far is carried
    forward, so each side is shuffled once and no pair of rows is made. Equal times are
    ordered by ``tie`` on the right (nulls first); right rows at a left row's time come
    first. Rows with a null key or time never match and stay out of the lines. Column names
    may be anything; columns of the result may repeat if they do on both sides.

    Keys are counted first. The line of one with more than ``split_rows`` rows is cut into
    ranges of time of about so many, at approximate quantiles, and each range starts with
    the last right row of the ranges before it, so that a key with most of the rows is the
    work of many tasks. Rows of one key and one time stay together. Of the heaviest keys
    SPLIT_KEYS are cut, into SPLIT_PARTS at most: a thousandth of all rows needs no cut.
    """
    keys = [f"k{i}" for i in range(len(by))]
    kinds = [right.schema[b].dataType for b in by]
    mine = [F.col(quoted(b)).alias(k) for b, k in zip(by, keys, strict=True)]
    seen = right.select(*mine, F.col(quoted(right_time)).alias("t"), F.lit(0).alias("side"), F.col(quoted(tie)).alias("tie"), F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]).alias("seen"))
    row = F.struct(*[F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(left.columns)])
    asked = left.select(*[m.cast(kind).alias(k) for m, kind, k in zip(mine, kinds, keys, strict=True)], F.col(quoted(left_time)).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(seen.schema["tie"].dataType).alias("tie"), F.lit(None).cast(seen.schema["seen"].dataType).alias("seen"), row.alias("row"))
    whole = " and ".join(f"{c} is not null" for c in (*keys, "t"))
    lonely = asked.where(f"not ({whole})")
    seen = seen.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType))
    line = seen.where(whole).unionByName(asked.where(whole))

    cut = _cuts(line, keys, split_rows)
    line = line.withColumn("part", F.lit(0)) if cut is None else _in_parts(line, keys, cut)
    w = W.partitionBy(*keys, "part").orderBy("t", "side", "tie").rowsBetween(W.unboundedPreceding, 0)
    carried = line.withColumn("seen", F.last("seen", ignorenulls=True).over(w)).where("side = 1").select("row", "seen")
    out = carried.union(lonely.select("row", "seen"))
    return out.select(*[F.col(f"row.r{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"seen.c{i}").alias(c) for i, c in enumerate(columns)])


def _cuts(line: DataFrame, keys: list[str], split_rows: int) -> DataFrame | None:
    """(keys, at): where the lines of heavy keys are cut; at most SPLIT_KEYS rows of SPLIT_PARTS numbers. None if no key is heavy."""
    heavy = line.groupBy(*keys).count().where(F.col("count") > split_rows).orderBy(F.col("count").desc()).limit(SPLIT_KEYS).collect()
    if not heavy:
        return None
    spark = line.sparkSession
    kinds = T.StructType([line.schema[k] for k in keys])
    few = spark.createDataFrame([tuple(r)[:-1] for r in heavy], kinds)
    parts = min(SPLIT_PARTS, -(-heavy[0]["count"] // split_rows))
    grid = [i / parts for i in range(1, parts)]
    at = F.array_sort(F.array_distinct(F.percentile_approx("t", grid, 10 * parts)))
    return line.join(F.broadcast(few), keys, "left_semi").groupBy(*keys).agg(at.alias("at"))


def _in_parts(line: DataFrame, keys: list[str], cut: DataFrame) -> DataFrame:
    """The lines with the number of the range that each row is in, and before each range but the first the last right row up to it."""
    cut = cut.sparkSession.createDataFrame(cut.collect(), cut.schema)  # looked at once: its bound is SPLIT_KEYS * SPLIT_PARTS numbers
    # Of the cuts a row keeps its range and how many there are: what is sorted or grouped below must not hold them all in every row.
    line = line.join(F.broadcast(cut), keys, "left").select(*line.columns, _before(F.col("t"), F.col("at")).alias("part"), F.when(F.col("at").isNotNull(), F.size("at")).alias("cuts"))
    last = line.where("side = 0 and cuts is not null").groupBy(*keys, "part").agg(F.max_by("seen", F.struct("t", "tie")).alias("seen"), F.first("cuts").alias("cuts"))
    after = last.withColumn("next", F.lead("part").over(W.partitionBy(*keys).orderBy("part")))
    starts = after.where("part < cuts").withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.coalesce("next", "cuts"))))
    blank = [F.lit(None).cast(line.schema[c].dataType).alias(c) for c in ("t", "tie", "row")]
    starts = starts.select(*keys, F.lit(-1).alias("side"), "seen", "part", *blank)
    return line.drop("cuts").unionByName(starts)


def _before(value: F.Column, rising: F.Column) -> F.Column:
    """How many of an array's rising values, fewer than SPLIT_PARTS, are less than a value (0 without an array): found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(SPLIT_PARTS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(rising, n + step - 1) < value, n + step).otherwise(n))


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ: by name, what is missing null."""
    out = parts[0].select("*")
    for p in parts[1:]:
        out = out.unionByName(p.select("*"), allowMissingColumns=True)
    return out
