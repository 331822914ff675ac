"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, large


def components(links: DataFrame, a: str, b: str, tmp: Scratch) -> DataFrame:
    """Label the nodes of undirected ``links``: rows ``node, root`` with the smallest node of each component.

    Every round is two grouped minima and two joins, written to ``tmp``, until all components are stars, as links that span them
    already may be from the start; the number of rounds grows with the logarithm of the graph. A hub's links are pre-aggregated and never gathered. A link of which an
    end is null joins nothing; nodes without links are not in the result.
    """
    edges = tmp.keep(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # All are stars when every node with a smaller neighbour has no other.
        if not both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).agg(F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()[0]:
            break
        # Large star: every larger neighbour, and the node itself, hang on the node's smallest neighbour.
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        big = both.filter("v > u").join(large(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours, and the node itself, hang on the smallest of them.
        small = big.groupBy("u").agg(F.min("v").alias("m"))
        near = big.join(large(small), "u")
        before, edges = edges, tmp.keep(
            near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links"
        )
        tmp.drop(before)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
