"""Connected components of an edge table by alternating star contractions, all in Spark.

Each round writes its edges to the shared folder, which cuts the lineage; only a count and a checksum
reach the driver. (Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import drop, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours move to the least one. Small: smaller neighbours and the node itself do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(least, "u").withColumn("m", F.least("m", "u"))
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node reachable) for every node of an edge. Loops and repeats don't matter; no edges give no rows."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    mark = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    now, seen = stage(now, "edges"), None
    while (found := tuple(now.agg(*mark).first())) != seen and found[0]:
        seen, last = found, now
        now = stage(_star(_star(last, True), False), "edges")
        drop(last)
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
