"""Connected components by alternating large and small stars, edges never leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import HOT_ROWS, materialize, salted_join


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links(a, b); label is the smallest node of its component.

    A round makes each node's larger neighbours neighbours of its smallest neighbour, then does the same
    with its smaller ones. Each component ends as a star around its smallest node, after a number of
    rounds that grows with the logarithm of its size; rounds end only where all are stars. The
    neighbours of a node that has very many are dealt out to several tasks. Self-links don't matter; without
    links there are no rows.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while True:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.unionByName(turned).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        most, open_ = both.agg(F.max("rows"), F.max(F.when(F.col("m") < F.col("u"), F.col("rows")))).first()
        if (open_ or 1) == 1:  # whoever has a smaller neighbour has no other one: all are stars
            break
        least = both.select("u", F.least("m", "u").alias("m"))
        hot = most > HOT_ROWS
        large = (salted_join(turned, least, "u", "v") if hot else turned.join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        large = materialize(large, "edges") if hot else large
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (salted_join(large, least, "u", "v") if hot else large.join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where(F.col("u") != F.col("v")).distinct(), "edges")
    stars = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.unionByName(centres)
