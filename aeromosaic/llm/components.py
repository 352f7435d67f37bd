"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle, with_least


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = with_least(both, ["u"], "v", "m").where("v > u")
    return known.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    ends = F.explode(F.array("v", "u")).alias("u")
    return with_least(edges, ["u"], "v", "m").select(ends, F.col("m").alias("v")).where("u > v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots, the smallest of their component.

    A node with many neighbours is a key of partial minima, and in joins it is dealt by salts. Rounds end
    when every node has one parent and no parent has one, which is tested exactly.
    """
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = settle(edges.distinct())
    while True:
        n, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
        parents = edges.select(F.col("v").alias("u")).distinct()
        if n == nodes and edges.join(parents, "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = settle(_small_star(_large_star(edges)).distinct())
