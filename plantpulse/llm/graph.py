"""Connected components of large link tables by alternating large and small
stars: every round moves all neighbours of a vertex to the smallest one it
knows, until the links are stars around each component's smallest vertex. Each
round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch


def _star(sym: DataFrame, large: bool) -> DataFrame:
    """Links (u, v): the larger neighbours of u (large) or u itself and its
    smaller ones (small) move to the smallest vertex around u."""
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    both = sym.join(least, F.col("u") == F.col("c"))
    if large:
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return both.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``links`` (a, b); the component
    is its smallest vertex."""
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    mark = None
    while True:
        sym = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        before, now = now, scratch(_star(_star(sym, True), False), "stars")
        release(before)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
