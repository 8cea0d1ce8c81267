"""Connected components of links, as DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def connected(links: DataFrame) -> DataFrame:
    """(id, root) for every id of links (a, b): the smallest id that it reaches. Ids without links are not listed.

    Alternates large and small stars (Kiveris et al. 2014): each id's neighbours are joined to the smallest one, until
    nothing changes. A step keeps the number of links and aggregates by partial minima, so that an id with very many links is
    only a key of a join, which Spark can split; the number of steps grows with the logarithm of the longest path."""
    with scratch(links.sparkSession):
        edges = materialize(_settled(links), "settled", keep=True)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _settled(links: DataFrame) -> DataFrame:
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = materialize(small.filter("a <> b").distinct(), "links")
        # settled when each id has one link and no root has a link of its own
        edges = after
        both = after.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(after.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if both.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty():
            return edges
