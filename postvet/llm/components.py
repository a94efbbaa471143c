"""Connected components of a graph given as links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.session import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m")
    )
    return (
        both.filter("v > u").join(least, F.col("u") == F.col("w"))
        .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least.withColumnRenamed("a", "w"), F.col("a") == F.col("w"))
    return (
        others.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b"))).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link: (node, root).

    `links` has two columns of node ids; direction, repeats and loops don't matter.
    Links are contracted by alternating star steps until they form stars. Each round
    is written to the shared folder and only two figures of it reach the driver.
    A node with many links is aggregated on the map side and its join is split by AQE.
    """
    a, b = links.columns
    now = stored(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    mark = F.struct(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    )
    before = now.select(mark.alias("m")).first()["m"]
    while before["n"]:
        now = stored(_small_star(_large_star(now)))
        after = now.select(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
