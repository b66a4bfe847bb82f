"""Connected components of an edge table by alternating large and small stars, natively and without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import drop_scratch, parts_for, written


def _least(edges: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and its neighbours. Minima are pre-aggregated and joined, so a hub can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    found = _least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    small = found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v")))
    return small.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge; root is the least node of its component. edges: two long columns of a stored table."""
    u, v = edges.columns
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct()
    parts = parts_for(edges.select(u, v, F.col(u).alias("w")))  # a star has two edges at most for each
    now, mark = written(now, "edges", parts), None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(told) == mark or told[0] == 0:
            break
        mark = tuple(told)
        then, now = now, written(_star(now), "edges", parts)
        drop_scratch(then)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
