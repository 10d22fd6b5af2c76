"""Comparison of predicted phrase sets with each other and with gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """sent_id, only_a, only_b (sorted) of sentences both hold. a, b: sent_id, phrases."""
    return differences_within(a.select("sent_id", F.col("phrases").alias("a")).join(b.select("sent_id", F.col("phrases").alias("b")), "sent_id"))


def differences_within(both: DataFrame) -> DataFrame:
    """The same of sets that stand in one row. both: sent_id, a, b."""
    return both.select("sent_id", F.array_sort(F.array_except("a", "b")).alias("only_a"), F.array_sort(F.array_except("b", "a")).alias("only_b"))


def micro_counts(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """n_pred, n_gold, n_both over all gold sentences, with precision, recall and f1."""
    return micro_counts_within(gold.select("sent_id", F.col("phrases").alias("gold")).join(pred.select("sent_id", F.col("phrases").alias("pred")), "sent_id", "left"))


def micro_counts_within(both: DataFrame) -> DataFrame:
    """The same of sets that stand in one row. both: gold, pred (null: none)."""
    both = both.select(F.array_distinct("gold").alias("g"), F.array_distinct("pred").alias("p"))
    n = both.agg(F.coalesce(F.sum(F.coalesce(F.size("p"), F.lit(0))), F.lit(0)).alias("n_pred"), F.coalesce(F.sum(F.size("g")), F.lit(0)).alias("n_gold"), F.coalesce(F.sum(F.coalesce(F.size(F.array_intersect("p", "g")), F.lit(0))), F.lit(0)).alias("n_both"))
    p, r = F.try_divide("n_both", "n_pred"), F.try_divide("n_both", "n_gold")
    return n.withColumns({"precision": p, "recall": r}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
