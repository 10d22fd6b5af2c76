"""Inference: segments, mentions, paths and tuples of new sentences under a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import mentions, quality, segment, tuples


def entity_phrases(sents: DataFrame, patterns: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """sent_id, phrases: entity and background segments in order."""
    scores = segment.scored_patterns(patterns)
    good = patterns.where(quality.passes_output(F.col("n"), F.col("quality")) & F.col("indicator").isin("EP", "BP")).select("gram")
    segs = segment.segments(segment.segmented(sents, scores, priors)).where("known").join(good, "gram", "left_semi")
    return segs.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("st", "gram"))).alias("a")).select("sent_id", F.transform("a", lambda x: x["gram"]).alias("phrases"))


def extract(sents: DataFrame, patterns: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """sent_id, subj, rels, obj of sentences (sent_id, tokens, tags, heads, types)."""
    found = mentions.extract_mentions(sents, entity_phrases(sents, patterns, priors))
    full = sents.join(found, "sent_id")
    relations = dict(map(tuple, segment.scored_patterns(patterns, tuple_mode=True).select("gram", "score").collect()))  # the model
    kept = {r.gram for r in patterns.where(quality.passes_output(F.col("n"), F.col("quality"), F.col("indicator"))).select("gram").collect()}
    return tuples.assemble(tuples.dependency_paths(full), full, relations, kept)
