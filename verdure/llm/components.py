"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of an edge ``(a, b)``; the root is the smallest node of its component.

    Alternates two contractions until every edge points from a node to its root: first every node hands its larger
    neighbours to its smallest one, then its smaller ones. Hubs only ever pass a minimum through the aggregate, and
    the joins on them may be split by AQE. Each round is written, so a lost executor repeats one round at most, and
    the tables of the round before are deleted then.
    Edges with a null end are ignored; an edge from a node to itself gives the node alone.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null")
    ends = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    alone = ends.where("u = v").select("u", "v")
    links, last = ends.where("u <> v"), []
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        larger = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        larger = materialize(larger, "star")
        lowest = larger.groupBy("u").agg(F.min("v").alias("low"))
        rest = larger.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = materialize(lowest.select("u", F.col("low").alias("v")).unionByName(rest).distinct(), "star")
        discard(larger, *last)
        last = [links]
        inner = links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi")
        if inner.isEmpty() and links.groupBy("u").count().where("count > 1").isEmpty():
            break
    found = links.unionByName(links.select(F.col("v").alias("u"), "v")).unionByName(alone)
    return found.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
