"""Connected components by alternating large-star and small-star.

Large-star links every larger neighbour of a node to its smallest neighbour, small-star links the
smaller ones to it; repeated until every component is a star around its smallest node. Both keep
the components as they are and never make more links than there were, whatever the size of a
component, and the number of rounds grows with the logarithm of the longest chain.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.plans.scratch import keep, stored_rows
from pressroom.plans.skew import spread_join


def large_star(links: DataFrame) -> DataFrame:
    """``a, b`` with a > b: each larger neighbour of a node linked to the smallest one, the node included."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = spread_join(both, least, ["a"], by="b", at_most=2 * stored_rows(links))
    return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """``a, b`` with a > b: each node and its other smaller neighbours linked to the smallest one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = spread_join(links, least, ["a"], by="b").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for every node of ``edges(a, b)``, the smallest node it is linked to."""
    links = keep(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while stored_rows(links):
        links = keep(small_star(keep(large_star(links))))
        several = links.groupBy("a").count().filter("count > 1").select("a")
        not_centre = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
        if several.unionByName(not_centre).isEmpty():
            break
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
