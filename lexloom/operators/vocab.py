"""Dictionaries: dense ids in first-seen order, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .annotate import SENT

BUCKET = 4096 * SENT  #: sentences whose first-seen words are numbered together


def first_seen_ids(toks: DataFrame) -> DataFrame:
    """token, token_id (from 1, by first position), is_punc.

    The numbers come from a count per bucket of sentences and a rank within it, so no single task sorts all words.
    """
    first = toks.groupBy("token").agg(F.min(F.struct("sent_id", "pos")).alias("at"), F.first("is_punc").alias("is_punc")).withColumn("bucket", F.floor(F.col("at.sent_id") / BUCKET))
    counts = first.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("at"))
    return first.withColumn("rank", rank).join(before, "bucket").select("token", (F.col("before") + F.col("rank")).alias("token_id"), "is_punc")


def encoded(toks: DataFrame, vocab: DataFrame, oov: int = -1) -> DataFrame:
    """sent_id, ids: sentences as ids in token order; words outside the vocabulary get ``oov``."""
    rows = toks.join(vocab.select("token", "token_id"), "token", "left").groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(oov)).alias("id")))).alias("a"))
    return rows.select("sent_id", F.transform("a", lambda x: x["id"]).alias("ids"))


def decoded(coded: DataFrame, vocab: DataFrame) -> DataFrame:
    """sent_id, tokens of (sent_id, ids); unknown ids decode to null."""
    rows = coded.select("sent_id", F.posexplode("ids").alias("pos", "token_id")).join(vocab.select("token", "token_id"), "token_id", "left")
    return rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("a")).select("sent_id", F.transform("a", lambda x: x["token"]).alias("tokens"))


def sentence_idf(sents: DataFrame) -> DataFrame:
    """idf's table of sentences (tokens): a word counts once in its row, so that only counts travel, not the words of each sentence."""
    n = sents.where(F.size("tokens") > 0).agg(F.count("*").alias("n_sents"))
    df = sents.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n_sents") / F.col("df") + 1e-8).alias("idf"))  # one row beside each


def idf(toks: DataFrame) -> DataFrame:
    """token, df, idf = ln(sentences / df + 1e-8)."""
    n = toks.select("sent_id").distinct().agg(F.count("*").alias("n_sents"))
    df = toks.select("sent_id", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n_sents") / F.col("df") + 1e-8).alias("idf"))  # one row beside each
