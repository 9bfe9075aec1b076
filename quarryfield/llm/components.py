"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a distributed aggregation and join; nothing but two numbers a round (the
edge table's size and checksum) comes to the driver.  Each round is written to the shared
folder, which cuts the lineage.  A node with very many neighbours only ever meets partial
minima and a join that the adaptive skew handling may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, where: str) -> DataFrame:
    """``edges``: two long columns a, b, no nulls.  Gives node, root (the smallest node of its component) for each node with an edge."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before, turn = None, 0
    while True:
        e = materialise(e, f"{where}/round-{turn}")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before, turn = now, turn + 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
