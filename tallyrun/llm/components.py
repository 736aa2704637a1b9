"""Connected components of a large edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of an edge table: rows (node long, label long), label a node of its component.

    Each round every node points to the least of itself and its neighbours, edges are
    redrawn between the nodes pointed to, and loops and repeats go. The nodes left at least
    halve, so the rounds are logarithmic when ids are spread like hashes, which callers see
    to. Nulls in either column are ignored; an empty table gives an empty one. The least
    neighbour is a partial aggregate, so a hub costs no more than its rows; the joins are
    on plain keys and left to adaptive skew splitting. Each round is written to the shared
    folder, which bounds the lineage that a lost executor can make Spark repeat.
    """
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    links = written(links, "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    links = links.where("a <> b")
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        least = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to")), "least")
        labels = written(
            labels.join(least.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")),
            "labels",
        )
        one = links.join(least.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").select("a2", "b")
        two = one.join(least.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").where("a2 <> b2")
        links = written(two.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    return labels
