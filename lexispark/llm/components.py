"""Connected components by alternating large-star and small-star rounds, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import Scratch, if_small


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of the component.

    links: (a, b) of comparable ids, any order, repeats and loops allowed. A node with very
    many links is no single group: minima are added up per task and written, so the join back to the
    links is one that Spark can split, or one without a shuffle. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, last, turn = scratch.save(edges, "edges0"), None, 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"low{turn}")
        large = both.join(if_small(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"star{turn}")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"least{turn}")
        small = large.join(if_small(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        turn += 1
        edges = scratch.save(small, f"edges{turn}")
        scratch.drop(*(f"{x}{turn - 1}" for x in ("edges", "low", "star", "least")))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
