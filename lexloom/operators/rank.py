"""Ranking of tuples by translation embeddings, and ordered merging of result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def l1_translation(e1: Column, rel: Column, e2: Column) -> Column:
    """|e1 + rel - e2|, summed over the dimensions."""
    d = F.zip_with(F.zip_with(e1, rel, lambda a, r: a + r), e2, lambda x, b: F.abs(x - b))
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x)


def mean_vector(dims: int, vec: str = "vec") -> Column:
    """Aggregate: the mean of a vector column, dimension by dimension (sums are partial before the shuffle)."""
    return F.array(*[F.avg(F.get(vec, i)) for i in range(dims)])


def translation_scores(tuples: DataFrame, entities: DataFrame, relations: DataFrame, dims: int) -> DataFrame:
    """tuple_id, score of tuples (tuple_id, subj, obj, rels) whose subject, object and at least one relation have vectors.

    Score: the L1 distance of subject plus the mean relation vector to the object; the least is the best.
    """
    rel = tuples.select("tuple_id", F.explode("rels").alias("key")).join(relations, "key").groupBy("tuple_id").agg(mean_vector(dims).alias("rel"))
    e = lambda name: entities.select(F.col("key").alias(name), F.col("vec").alias(f"{name}_vec"))
    rows = reduce(lambda a, b: a.join(*b), [(e("subj"), "subj"), (e("obj"), "obj"), (rel, "tuple_id")], tuples)
    return rows.select("tuple_id", l1_translation(F.col("subj_vec"), F.col("rel"), F.col("obj_vec")).alias("score"))


def ordered_merge(main: DataFrame, other: DataFrame) -> DataFrame:
    """doc, ord, side, text: rows of ``other`` before those of ``main`` within each document; documents that main lacks are left out."""
    kept = other.join(main.select("doc").distinct(), "doc", "left_semi")
    return kept.withColumn("side", F.lit(0)).unionByName(main.withColumn("side", F.lit(1)))


def verbal_tuples(tuples: DataFrame) -> DataFrame:
    """Tuples with both arguments whose relation tags hold a verb or a preposition."""
    return tuples.where((F.trim("subj") != "") & (F.trim("obj") != "") & (F.col("rel_tags").contains("VB") | F.col("rel_tags").contains("IN")))


def final_output(tuples: DataFrame, cut: int = 0) -> DataFrame:
    """doc (counted from the cut-off on), subj, rel, obj, score of the documents from the cut-off on, best first."""
    return tuples.where(F.col("doc") >= cut).select((F.col("doc") - cut).alias("doc"), "subj", "rel", "obj", "score").orderBy("doc", "score", "subj", "rel", "obj")
