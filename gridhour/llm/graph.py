"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhour.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the least node.

    Each round links larger neighbours, then smaller ones, to the least neighbour known, and
    is written to the shared folder. The edges never grow in number beyond their count at the
    start plus the nodes; rounds grow with the logarithm of the longest path. Minima are
    taken before the join, from a stored table, so a node with very many neighbours is a
    partition that adaptive execution can split. Loops are dropped; no edges give no rows.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, before = stored(tidy, "edges"), None
    while (sign := _signature(now)) != before:
        before = sign
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select("lo", "hi"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = stored(large, "large")
        down = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "down")
        small = large.join(down, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        now = stored(small.unionAll(down.select("hi", "m")).distinct(), "edges")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
