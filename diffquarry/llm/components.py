"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node it reaches.

    edges: two columns of one orderable type; direction, repeats, self loops and rows with a null
    don't matter. An empty list gives an empty result. Each round keeps for a node only its links to
    one smallest neighbour, so no neighbour list is ever gathered; hot nodes are pre-aggregated by the
    partial min and their join partitions can be split. Rounds are written to the shared folder.
    The number of rounds grows with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).isNotNull().alias("p"), F.col(b).isNotNull().alias("q"))
    e = materialize(e.filter("p and q and hi <> lo").select("hi", "lo").distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()
        old, e = e, materialize(small, "stars")
        discard(old)
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
