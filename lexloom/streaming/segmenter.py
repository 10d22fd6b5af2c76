"""Segmentation over a stream: each sentence is segmented on its own, so the batch operator runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate, segment
from ..schema import DOCUMENTS


def documents_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).parquet(folder)


def segmented_stream(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """sent_id, score, segments of a stream of documents; scores is a static table (gram, score)."""
    return segment.segmented(annotate.sentences(docs), scores)


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
