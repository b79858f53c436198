"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.session import discard, written


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id of the component) for every id of `edges` (a, b).

    Alternates two star operations until nothing changes: every node gives its larger
    neighbours its smallest neighbour, then its smaller ones and itself the smallest of them.
    Paths shrink to stars in a number of rounds that grows with the logarithm of their length.
    Each round is written to the shared folder, and the one before is removed. Stars end it. Loops
    and repeated edges do no harm, and an edge with a null end is left out.
    """
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    links = written(edges.filter("a <> b").select(*ends).distinct(), "links", drop_shuffles=True)
    while not _stars(links):
        last, links = links, written(_small_star(_large_star(links)), "links", drop_shuffles=True)
        discard(last)
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)


def _stars(links: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end itself: a round would change nothing."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("end")).select("end.*")
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up + down > 1").agg(F.count(F.lit(1))).first()[0] == 0


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
