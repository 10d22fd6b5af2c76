"""Readers. Companion files are joined by line number, never by hoping that partitions line up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema
from ..functions.text import split_nonempty, tagged_word
from ..operators.annotate import parsed_dependency


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), line; carriage returns are stripped. The files of a folder follow one another by path.

    Lines are numbered by a count per piece of a file, pieces in the order of path and offset, then the place within the piece.
    """
    from pyspark.sql import Window

    piece = ["file", "block"]
    rows = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy(*piece).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.select(*piece, "first", F.coalesce(F.sum("n").over(Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, piece).select((F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "line")  # a row per piece of a file


def words(spark: SparkSession, path: str, column: str = "tokens") -> DataFrame:
    """sent_id, words of blank-separated lines."""
    return lines(spark, path).select(F.col("line_no").alias("sent_id"), split_nonempty(F.col("line"), " ").alias(column))


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, ids; parts that are no number are left out."""
    return words(spark, path).select("sent_id", F.transform(F.filter("tokens", lambda t: t.rlike("^-?[0-9]+$")), lambda t: t.cast("int")).alias("ids"))


def case_codes(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("line_no").alias("sent_id"), F.col("line").alias("case_codes"))


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, deps of lines of idx_head_type (or idx_head) words."""
    return words(spark, path, "d").select("sent_id", F.transform("d", parsed_dependency).alias("deps"))


def corpus(spark: SparkSession, tokens: str, tags: str, deps: str | None = None, cases: str | None = None, mentions: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sentences of companion files, and (second) the sentences whose companions differ in length."""
    tables = [words(spark, tags, "tags")]
    if deps:
        tables.append(dependencies(spark, deps))
    if cases:
        tables.append(case_codes(spark, cases))
    if mentions:
        tables.append(entity_positions(spark, mentions))
    rows = reduce(lambda a, b: a.join(b, "sent_id", "left"), tables, words(spark, tokens))
    ok: Column = F.size("tokens") == F.size("tags")
    if deps:
        ok = ok & (F.size("tokens") == F.size("deps"))
    if cases:
        ok = ok & (F.size("tokens") == F.char_length("case_codes"))
    ok = F.coalesce(ok, F.lit(False))
    return rows.where(ok), rows.where(~ok).select("sent_id")


def entity_positions(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, mentions (start, end) of 's_e s_e' lines."""
    part = lambda x, i: F.get(F.split(x, "_"), i).cast("int")
    return words(spark, path, "p").select("sent_id", F.transform("p", lambda x: F.struct(part(x, 0).alias("start"), part(x, 1).alias("end"))).alias("mentions"))


def stopword_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike("^[0-9]+$")).select(F.col("value").cast("int").alias("token_id"))


def tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).option("sep", "\t").option("quote", "").csv(path)


def punctuation_ids(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "token_id int, punc string")


def token_mapping(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "token_id int, token string")


def punctuation_mapping(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "punc string, normal string")


def tag_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tag string, grp string").option("sep", " ").csv(path)


def external_patterns(spark: SparkSession, path: str) -> DataFrame:
    """gram (ids), tags of lines 'id_TAG id_TAG'."""
    w = spark.read.text(path).select(F.transform(split_nonempty(F.col("value"), " "), tagged_word).alias("w"))
    return w.select(F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("gram"), F.array_join(F.transform("w", lambda x: x["tag"]), " ").alias("tags"))


def prune_list(spark: SparkSession, path: str) -> DataFrame:
    """section, tag of a list with ===unigram=== and ===expansion=== heads. The list is a few dozen lines."""
    from pyspark.sql import Window

    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(spark, path).withColumn("section", F.last(F.when(F.col("line").rlike("^===.*===$"), F.translate("line", "=", "")), ignorenulls=True).over(w))
    return rows.where(~F.col("line").rlike("^===") & (F.trim("line") != "")).select("section", F.trim("line").alias("tag"))


def expert_labels(spark: SparkSession, path: str, patterns: DataFrame | None = None) -> DataFrame:
    """label, gram of lines 'label word word'; with patterns, only known grams."""
    w = split_nonempty(F.col("value"), " ")
    rows = spark.read.text(path).select(F.get(w, 0).cast("int").alias("label"), F.array_join(F.slice(w, 2, 1_000), " ").alias("gram")).where("label IS NOT NULL AND gram <> ''")
    return rows if patterns is None else rows.join(patterns.select("gram"), "gram", "left_semi")


def dictionary(spark: SparkSession, path: str, patterns: DataFrame | None = None) -> DataFrame:
    """gram of lines of ids: parts that are no number are skipped, a line with a negative one is left out; with patterns, only known grams."""
    w = F.filter(split_nonempty(F.col("value"), " "), lambda t: t.rlike("^-?[0-9]+$"))
    rows = spark.read.text(path).select(w.alias("w")).where((F.size("w") > 0) & ~F.exists("w", lambda t: t.startswith("-"))).select(F.array_join("w", " ").alias("gram")).distinct()
    return rows if patterns is None else rows.join(patterns.select("gram"), "gram", "left_semi")


def sentence_json(spark: SparkSession, path: str) -> DataFrame:
    """tokens, pos, mentions of JSON lines {tokens, pos, entityMentions}."""
    rows = spark.read.schema(schema.SENTENCE_JSON).json(path)
    m = lambda x: F.struct(F.get(x, 0).cast("int").alias("start"), F.get(x, 1).cast("int").alias("end"), F.get(x, 2).alias("text"))
    return rows.withColumn("mentions", F.transform("entityMentions", m)).drop("entityMentions")


def annotated_json(spark: SparkSession, path: str) -> DataFrame:
    """doc, sent, tokens, lemmas, tags, ner of annotator output (a JSON document a file)."""
    rows = spark.read.schema(schema.CORENLP_JSON).option("multiLine", True).json(path).withColumn("doc", F.input_file_name())
    s = rows.select("doc", F.posexplode("sentences").alias("sent", "s"))
    of = lambda f: F.transform("s.tokens", lambda t: t[f])
    return s.select("doc", "sent", of("word").alias("tokens"), of("lemma").alias("lemmas"), of("pos").alias("tags"), of("ner").alias("ner"))


def gold_json(spark: SparkSession, path: str) -> DataFrame:
    """article, sent_id, text, em1, em2, label; sentences without gold are left out."""
    rows = spark.read.schema(schema.GOLD_JSON).json(path).select(F.col("articleId").alias("article"), F.explode("sentences").alias("s"))
    return rows.select("article", F.col("s.sentId").alias("sent_id"), F.col("s.sentText").alias("text"), F.explode("s.relationMentions").alias("m")).select("article", "sent_id", "text", F.col("m.em1Text").alias("em1"), F.col("m.em2Text").alias("em2"), F.col("m.label").alias("label"))


def tagged_text(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, tokens, tags of word_TAG lines."""
    w = words(spark, path, "w").withColumn("w", F.transform("w", tagged_word))
    return w.select("sent_id", F.transform("w", lambda x: x["word"]).alias("tokens"), F.transform("w", lambda x: x["tag"]).alias("tags"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """key, vec of 'key v v' lines; the head line (two numbers) is left out."""
    w = F.split("value", " ")
    return spark.read.text(path).where(~F.col("value").rlike(r"^\d+ \d+\s*$")).select(F.get(w, 0).alias("key"), F.transform(F.slice(F.filter(w, lambda x: x != ""), 2, 1_000_000), lambda x: x.cast("double")).alias("vec"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """doc, surface, sim, second_rank of the linker's six columns."""
    return tsv(spark, path, schema.SEEDS).select("doc", "surface", "sim", "second_rank")


def whole_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, text of all files below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Elements of annotation XML (documents, entities, relations, events) as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
