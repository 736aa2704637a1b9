"""Samples that don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import plain
from ..names import quoted
from .relational import _free


def seeded_sample(df: DataFrame, n: int, seed: float, key: list[str] | None = None) -> DataFrame:
    """n rows in the order of a seeded hash of their key columns (all columns without one, so ties are equal rows)."""
    columns = key or df.columns
    return df.orderBy(F.xxhash64(F.lit(float(seed)), *columns), *columns).limit(n)


#: Bits of the hash that one pass over the data narrows the cut by.
_BITS = 16


def percent_sample(df: DataFrame, percent: float, seed: float, key: list[str] | None = None) -> DataFrame:
    """Exactly ``percent`` of the rows (the nearest number of them): those whose seeded hash is lowest. The same rows on every run and however they are dealt out.

    The hash that cuts them off is found by counting hashes by their leading bits and then
    within the one cell that holds it, some bits at a time, so nothing is sorted and a few
    counts come to the driver. Rows whose hash is the cut itself, which are those of one
    key, are told apart by all of their columns; rows that are the same as each other are
    taken in the number that is left.
    """
    if not 0 <= percent <= 100:
        raise ValueError("a percentage is from 0 to 100")
    h = "_" + "_".join(["hash", *[c.lower() for c in df.columns if c.lower().startswith("_hash")]])
    hashed = df.withColumn(h, _seeded(df, seed, key))
    cut, left = _cut(hashed, h, percent=percent)
    if cut is None:
        return df if left else df.limit(0)
    below, ties = hashed.where(F.col(h) < cut).drop(h), hashed.where(F.col(h) == cut).drop(h)
    if not left:
        return below
    # Of the ties: those with the lowest second hash, over all columns, and some of those that are equal throughout.
    again = ties.withColumn(h, _seeded(df, seed + 2, None))
    cut, left = _cut(again, h, number=left)
    if cut is None:
        return below.unionByName(ties)
    equal = again.where(F.col(h) == cut).groupBy(h).agg(*[F.first(F.col(quoted(c))).alias(c) for c in df.columns])  # one row, which stands for all of its kind
    copies = df.sparkSession.range(left).select(F.lit(cut).alias(h)).join(F.broadcast(equal), h).drop(h)
    return below.unionByName(again.where(F.col(h) < cut).drop(h)).unionByName(copies)


#: Rows that a partition of dealt rows has about, how many partitions there are at most, and from how many equal rows they are dealt apart.
DEAL_ROWS, DEAL_PARTS, DEAL_COPIES = 100_000, 10_000, 100_000


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, in partitions and an order that go by the rows alone and not by the files they lie in, for rand(seed) and samples over them.

    Rows go to partitions by a hash of all columns and lie there in the order of it and of a
    second one; rows that are alike in both are equal, so their order is no matter. How many
    partitions there are goes by the number of rows. One pass counts rows by the hash's
    leading bits: in cells that are crowded, equal rows become one that is counted, dealt out
    in blocks and copied in its place again, so no partition gets all copies of a row.
    """
    a, b, block, copies = (_free(df, name) for name in ("_hash_a", "_hash_b", "_block", "_copies"))
    columns = [part for c in df.columns for part in plain(df[quoted(c)], df.schema[c].dataType)] or [F.lit(0)]
    hashed = df.select("*", F.xxhash64(F.lit(1), *columns).alias(a), F.xxhash64(F.lit(2), *columns).alias(b))
    cell = F.shiftright(a, 64 - _BITS)
    cells = {r[0]: r[1] for r in hashed.groupBy(cell).count().collect()}
    rows = sum(cells.values())
    crowded = [c for c, n in cells.items() if n > DEAL_COPIES + 4 * rows / (1 << _BITS)]
    number = min(DEAL_PARTS, rows // DEAL_ROWS + 1)
    if not crowded:
        return hashed.repartition(number, a).sortWithinPartitions(a, b).drop(a, b)
    one = hashed.where(cell.isin(crowded)).groupBy(a, b).agg(F.count("*").alias(copies), *[F.first(quoted(c)).alias(c) for c in df.columns])
    blocks = one.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / DEAL_COPIES))))
    blocks = blocks.withColumn(copies, F.least(F.lit(DEAL_COPIES).cast("long"), F.col(copies) - F.col(block) * DEAL_COPIES))
    line = hashed.where(~cell.isin(crowded)).withColumns({block: F.lit(0).cast("long"), copies: F.lit(1).cast("long")}).unionByName(blocks)
    line = line.repartition(number, a, block).sortWithinPartitions(a, b, block)
    return line.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[quoted(c) for c in df.columns])


def _seeded(df: DataFrame, seed: float, key: list[str] | None) -> F.Column:
    columns = [part for c in key or df.columns for part in plain(df[quoted(c)], df.schema[c].dataType)]
    return F.xxhash64(F.lit(float(seed)), *columns)


def _cut(hashed: DataFrame, h: str, percent: float | None = None, number: int | None = None) -> tuple[int | None, int]:
    """The hash of the row at a place among all in order of hash, and how many rows of just that hash belong to those before the place. None if all do, or none (then 0)."""
    low, rest, rows = -(1 << 63), number, hashed
    for bits in range(64 - _BITS, -1, -_BITS):
        cells = dict(tuple(r) for r in rows.groupBy(F.shiftright(h, bits).alias("cell")).count().collect())
        if rest is None:
            rest = int(sum(cells.values()) * percent / 100 + 0.5)
        if bits == 64 - _BITS and (not rest or rest >= sum(cells.values())):
            return None, rest
        for cell in sorted(cells):
            if rest <= cells[cell]:
                break
            rest -= cells[cell]
        low = cell << bits
        if bits:
            rows = rows.where(F.col(h).between(low, low + (1 << bits) - 1))
    return low, rest
