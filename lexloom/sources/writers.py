"""Writers: ranked lists, splits, features, segmentations, tuples, dictionaries and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.quality import ranked


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def ranking_list(patterns: DataFrame, path: str) -> None:
    """quality \\t indicator \\t gram, best first, over the files in order."""
    write_tsv(patterns.orderBy(F.desc("quality"), F.desc("gram")).select("quality", "indicator", "gram"), path)


def results(patterns: DataFrame, path: str) -> None:
    """The four ranked lists, one folder each (bucket=E, B, R, unigram)."""
    ranked(patterns).select("bucket", "rank", "quality", "indicator", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def transitions(pairs: DataFrame, path: str) -> None:
    """A line per tag with its transition shares to every tag."""
    write_tsv(pairs.groupBy("tag_a").pivot("tag_b").agg(F.first("p")).na.fill(0.0), path)


def annotations(sents: DataFrame, prefix: str, columns: tuple[str, ...] = ("tokens", "tags")) -> None:
    """A text file per annotation, blank-separated, of sentences whose annotations are equally long."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(columns[0]) == F.size(c))
    for c in columns:
        write_text(sents.where(same).orderBy("sent_id").select(F.array_join(c, " ").alias("line")), "line", f"{prefix}.{c}")


def save_model(path: str, patterns: DataFrame, priors: DataFrame | None = None, tags: DataFrame | None = None, multi=None, single=None) -> None:
    """A segmentation model: its tables and forests."""
    patterns.write.mode("overwrite").parquet(f"{path}/patterns")
    for name, df in (("priors", priors), ("tags", tags)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, model in (("multi", multi), ("single", single)):
        if model is not None:
            model.write().overwrite().save(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, priors: bool = True) -> tuple[DataFrame, DataFrame | None]:
    return spark.read.parquet(f"{path}/patterns"), spark.read.parquet(f"{path}/priors") if priors else None


def load_forest(path: str):
    from pyspark.ml.classification import RandomForestClassificationModel

    return RandomForestClassificationModel.load(path)
