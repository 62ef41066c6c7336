"""Connected components of a link table, by alternating star contraction on DataFrames.

Every round points nodes at smaller neighbours and leaves the components as they are; rounds
are written to the shared folder, so a lost executor costs one round. A node with very many
links is met by map-side minima and by joins that adaptive execution may split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large star) or smaller neighbours to the smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).withColumn("m", F.least("c", "m"))
    joined = both.join(least, F.col("a") == F.col("c"))
    if large:
        made = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return made.where(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: each child has one parent, and no parent is a child."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("parents"), F.lit(1).alias("children"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("parents").alias("parents"), F.sum("children").alias("children"))
    return nodes.where("parents > 1 or parents = 1 and children > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``edges`` has columns a and b of one orderable type. NULLs and self-links are no links.
    Rounds end as soon as all links are stars: a component is then one star around its
    smallest node, since links go from the larger to the smaller node.
    """
    now = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        now = stage(_star(_star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
