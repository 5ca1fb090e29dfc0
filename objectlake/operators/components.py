"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.session import discard, materialise


def connected_components(links: DataFrame, left: str = "a", right: str = "b", kind: str = "long") -> DataFrame:
    """(id, component) for every id in links; component is the smallest id that it is connected to. Ids are of type kind.

    Large-star and small-star steps: each id hands its smallest neighbour to its other neighbours, so
    long chains shrink to stars in a logarithmic number of rounds. Only edges move; each round is
    written out, which cuts lineage, and the rounds end when all edges are stars.
    """
    both = links.select(F.col(left).cast(kind).alias("a"), F.col(right).cast(kind).alias("b")).filter("a is not null and b is not null")
    given = materialise(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "given")
    edges = given.filter("a <> b")
    while _open(edges):
        # Large star: every larger neighbour of a node is tied to the smallest of its neighbours and itself.
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            around.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct()
        )
        # Small star: every smaller neighbour of a node, and the node, is tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        new = materialise(small, "edges")
        discard(edges)
        edges = new
    # An edge leads to a smaller id, so an id's component is the smallest that it is named with.
    own = lambda rows, c: rows.select(F.col(c).alias("id"), F.col(c).alias("component"))
    named = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(own(edges, "b")).union(own(given.filter("a = b"), "a"))
    return named.groupBy("id").agg(F.min("component").alias("component"))


def _open(edges: DataFrame) -> bool:
    """Whether edges (a > b) are not yet stars: an id has two smaller neighbours, or one smaller and one larger."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return bool(ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").limit(1).count())
