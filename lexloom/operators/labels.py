"""Distant and expert labels of patterns, and the samples taken of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def distant_labels(patterns: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """patterns with label: 1 in the entity dictionary (which wins), 2 in the relation dictionary, 0 otherwise."""
    e = entities.select("gram").distinct().withColumn("e", F.lit(1))
    r = relations.select("gram").distinct().withColumn("r", F.lit(1))
    return patterns.join(e, "gram", "left").join(r, "gram", "left").withColumn("label", F.when(F.col("e").isNotNull(), 1).when(F.col("r").isNotNull(), 2).otherwise(0)).drop("e", "r")


def with_expert(labelled: DataFrame, expert: DataFrame) -> DataFrame:
    """Expert labels (label, gram) of known patterns go before distant ones."""
    x = expert.select("gram", F.col("label").alias("expert")).groupBy("gram").agg(F.max("expert").alias("expert"))
    return labelled.join(x, "gram", "left").withColumn("label", F.coalesce("expert", "label")).drop("expert")


def capped(positives: DataFrame, limit: int, order: Column) -> DataFrame:
    """At most ``limit`` of the positives, the first by ``order`` (a random or hash order); -1: all of them."""
    return positives if limit < 0 else positives.orderBy(order, "gram").limit(limit)


def sampled_by_length(patterns: DataFrame, total: int, order: Column) -> DataFrame:
    """A sample with every length's share of the whole: the first by ``order`` within a length."""
    n = patterns.groupBy("n").agg(F.count("*").alias("have"))
    every = n.agg(F.sum("have").alias("every"))
    quota = n.crossJoin(F.broadcast(every)).select("n", F.floor(F.lit(total) * F.col("have") / F.col("every")).alias("quota"))  # a row per length
    rank = F.row_number().over(Window.partitionBy("n").orderBy(order, "gram"))
    return patterns.withColumn("rank", rank).join(quota, "n").where(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def without_wrong(labelled: DataFrame) -> DataFrame:
    """A positive label of a pattern that never stands alone in the best segmentation becomes unknown."""
    return labelled.withColumn("label", F.when((F.col("freq") == 0) & (F.col("label") == 1), None).otherwise(F.col("label")))


def bootstrap(labelled: DataFrame, scores: DataFrame, keep: float = 0.8, ratio: int = 2, order: Column | None = None) -> DataFrame:
    """Self-training labels: positives whose score holds up stay, and ``ratio`` times as many unlabelled patterns of the least scores become negatives."""
    both = labelled.join(scores.select("gram", "quality"), "gram")
    good = both.where((F.col("label") == 1) & (F.col("quality") >= 1 - keep)).drop("quality")
    n = good.count()
    bad = both.where(F.coalesce("label", F.lit(0)) == 0).orderBy("quality", *([order] if order is not None else []), "gram").limit(ratio * n).drop("quality").withColumn("label", F.lit(0))
    return good.unionByName(bad)
