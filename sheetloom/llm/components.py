"""Connected components of a link table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _nearest(pairs: DataFrame) -> DataFrame:
    """For (u, v): u and the least of u and its v. The minimum is taken before rows move, so a
    node with very many links is a row a task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (node, component): the least node that a node reaches.

    Each round hangs the larger neighbours of every node on its least neighbour, then does the
    same with the smaller ones; it ends when every node hangs on its component's least node.
    Nothing is collected; rounds are written to the shared folder. Links with a null end are left
    out; a link of a node with itself gives a component of one.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    stars = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = hung.union(_nearest(both).select("u", F.col("m").alias("v"))).where("u >= v").distinct()
        least = _nearest(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, stars = stars, materialize(small.where("u >= v").distinct(), "links")
        discard(before)
        proper = stars.where("u <> v")
        torn = proper.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m <> x").select("u")
        deep = proper.select(F.col("v").alias("u")).join(proper.select("u"), "u", "left_semi")
        if torn.union(deep).isEmpty():  # links keep what is connected, so a forest of stars is the answer
            return stars.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component"))
