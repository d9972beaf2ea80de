"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fairlend.llm.tables import stored


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is its smallest reachable node.

    Alternates two steps until every component is a star around its smallest
    node: each node links its larger neighbours, then its smaller ones, to its
    smallest neighbour.  Rounds grow with the logarithm of a component's size;
    each writes a table.  Rows with nulls or a = b link nothing; a and b have
    one orderable type.
    """
    star = stored(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                  .distinct(), name)
    while not _is_forest_of_stars(star):
        both = star.select(F.col("v").alias("x"), F.col("u").alias("y")).union(star.select("u", "v"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = stored(both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
                       .distinct(), name)
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .union(low.select("v", "m")))
        star = stored(small.distinct(), name)
    return star.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        star.select("u", "u").distinct())


def _is_forest_of_stars(star: DataFrame) -> bool:
    rows, nodes = star.groupBy("v").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    if rows is None:
        return True
    return rows == nodes and star.select("u").join(star.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
