"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (large) or its smaller (small) neighbours to the least of its neighbourhood.

    The least is a written aggregate joined back: both sides of the join are dealt anew, so that a node with very
    many neighbours is split among tasks.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select(F.col("v"), F.col("u"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least member) for every node of the edges (a, b: long). Each round is a written table."""
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    said = None
    for _ in range(max_rounds):
        sign = now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first()
        if said == tuple(sign):
            break
        said = tuple(sign)
        if not sign[0]:
            break
        now = written(_stars(_stars(now, True), False), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
