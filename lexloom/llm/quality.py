"""Operator 10: quality rules with cross-document line frequency. DataFrame functions only.

Base rules judge a document by its own words; the method judges it by lines that its host repeats. Every
line with a word is normalised (lower case, white space runs as one blank) and hashed to 128 bits. For each
host the distinct texts that hold the line are counted, and set against the host's distinct texts (copies of
one text count once on both sides: they are the business of deduplication, and their lines are no
boilerplate). A line is above its limit when at least ``min_docs`` texts hold it and these are more than
``max_share`` of the host's texts or ``max_docs`` at least, however large the host. Such lines are taken out,
and a document that keeps fewer than ``min_words`` words after losing some is depleted and rejected.

Texts are read once: one narrow pass measures each and hashes its lines into a small written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS, WINDOW = 20, 8
MIN_DOCS, MAX_SHARE, MAX_DOCS = 20, 0.02, 200
#: White space other than single blanks and line ends.
ODD = ("  ", "\t", "\x0b", "\x0c", "\r")


def _odd(text: Column) -> Column:
    out = F.lit(False)
    for x in ODD:
        out = out | text.contains(x)
    return out


def words_of(text: Column, odd: Column) -> Column:
    flat = F.when(odd, F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(flat, " "), "")


def _starts_of_repeats(a: Column) -> Column:
    """Of an ordered array of (k, i): the i, ascending, whose k another entry has too."""
    at = lambda j: F.get(a, j).getField("k")
    repeated = F.transform(a, lambda x, j: F.when((x.getField("k") == at(j - 1)) | (x.getField("k") == at(j + 1)), x.getField("i")))
    return F.sort_array(F.filter(repeated, lambda i: i.isNotNull()))


def with_repeated_words(docs: DataFrame, words: str, n: int = WINDOW) -> DataFrame:
    """docs with n_repeat_words: how many words lie in n-word windows that occur at least twice.

    Hashes rule out most documents; equal hashes are checked on the words. Each step is a column of its own,
    as lambdas in lambdas cost more to analyse than to run.
    """
    w, h, a = F.col(words), F.col("_h"), F.col("_a")
    docs = docs.withColumn("_h", F.transform(w, lambda x: F.xxhash64(x)))
    have = 1
    while have < n:  # hashes of 2, 4, 8 words from those of half as many
        step = min(have, n - have)
        docs = docs.withColumn("_h", F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda x, y: F.xxhash64(x, y)))
        have += step
    docs = docs.withColumn("_h", F.when(F.size(w) > n, F.slice(h, 1, F.greatest(F.size(w) - n + 1, F.lit(0)))).otherwise(F.array().cast("array<long>")))
    none = F.array().cast("array<int>")
    keyed = F.sort_array(F.transform(h, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    docs = docs.withColumn("_a", F.when(F.size(F.array_distinct(h)) < F.size(h), keyed))
    docs = docs.withColumn("_a", F.coalesce(_starts_of_repeats(a), none))
    docs = docs.withColumn("_a", F.sort_array(F.transform(a, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]).alias("k"), i.alias("i")))))
    docs = docs.withColumn("_a", _starts_of_repeats(a))
    covered = F.transform(a, lambda i, j: F.least(F.lit(n), F.coalesce(F.get(a, j + 1) - i, F.lit(n))))
    return docs.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda x, y: x + y).cast("long")).drop("_h", "_a")


def base_metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. A null text has no words."""
    text, w, worded = F.col("_t"), F.col("_w"), F.col("_l")
    docs = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit(""))).withColumn("_odd", _odd(text))
    docs = docs.withColumns({"_w": words_of(text, F.col("_odd")), "_l": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")})
    docs = docs.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
    }).drop("_t", "_odd", "_l")
    docs = with_repeated_words(docs, "_w").drop("_w")
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _normalised(lines: Column) -> Column:
    """Lines (a text, or one line of it) in lower case, with one blank for each run of white space but line ends."""
    return F.lower(F.when(_odd(lines), F.regexp_replace(lines, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(lines))


def _key(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))


def _lines(text: Column) -> Column:
    """(line, words) of every line with a word: the hash of the normalised line, and its number of words."""
    trimmed = F.filter(F.transform(F.split(_normalised(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(trimmed, lambda x: F.struct(_key(x).alias("line"), (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def frequent_lines(measured: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """host, line: those above the limit. A text's copies are reduced to one row first; the row without a line counts the host's texts."""
    texts = measured.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    line = F.explode(F.array_append(F.array_distinct(F.transform("lines", lambda x: x["line"])), F.lit(None)))
    held = texts.select("host", line.alias("line")).groupBy("host", "line").agg(F.count("*").alias("texts"))
    held = written(held.where(F.col("line").isNull() | (F.col("texts") >= min_docs)), "line-counts")
    size = held.where("line IS NULL").select("host", F.col("texts").alias("all"))
    return held.where("line IS NOT NULL").join(size, "host").where((F.col("texts") > max_share * F.col("all")) | (F.col("texts") >= max_docs)).select("host", "line")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, the base metrics, base_failed, n_frequent_words, kept, and frequent (hashes of the lines to remove).

    Null texts have no words and fail the base rules. A null host (source) is a host of its own, and a table
    without that column is one host. Repeated rows give repeated results, and rows that share doc_id and text
    share their verdict. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _host(docs).alias("host"))
    measured = base_metrics(docs.withColumns({"text_key": _key(F.col("text")), "copy": F.monotonically_increasing_id(), "lines": _lines(F.col("text"))})).drop("text")
    measured = written(measured, "measured")
    above = frequent_lines(measured, min_docs, max_share, max_docs)
    lost = (
        measured.select("host", "copy", F.explode("lines").alias("x")).select("host", "copy", "x.*")
        .join(above, ["host", "line"])
        .groupBy("copy").agg(F.sum("words").cast("long").alias("n"), F.collect_set("line").alias("frequent"))
    )
    n = F.coalesce("n", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & ~((n > 0) & (F.col("n_words") - n < MIN_WORDS))
    return measured.join(lost, "copy", "left").select("doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", n.alias("n_frequent_words"), kept.alias("kept"), "frequent")


def _host(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string") if "source" in docs.columns else F.lit(None), F.lit("\0"))


def kept_documents(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """The table's kept rows with its columns; frequent lines are out of text, and n_chars (if there) is counted anew. Nulls, repeats and empty tables: see judge."""
    verdict = judge(docs, min_docs, max_share, max_docs).where("kept").select("doc_id", "host", "text_key", "frequent").dropDuplicates(["doc_id", "host", "text_key"])
    full = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row travels as one column, so that its names meet no others
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _key(full).alias("k"), _host(docs).alias("h"))
    on = keyed["id"].eqNullSafe(verdict["doc_id"]) & (keyed["h"] == verdict["host"]) & (keyed["k"] == verdict["text_key"])
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains(F.col("frequent"), _key(F.trim(_normalised(x))))), "\n")
    out = keyed.join(verdict, on).select("row", F.when(F.col("frequent").isNull(), F.col("row.text")).otherwise(left).alias("now"))
    new = {"text": F.col("now").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("now").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host", "text_key", "frequent")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
        lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
above AS (SELECT n.host, n.norm FROM n JOIN hosts USING (host) GROUP BY n.host, n.norm, docs
          HAVING count(DISTINCT n.text) >= 20 AND (count(DISTINCT n.text) > 0.02 * docs OR count(DISTINCT n.text) >= 200)),
lost AS (SELECT doc_id, sum(words) AS n FROM n JOIN above USING (host, norm) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        coalesce(lost.n, 0)::BIGINT AS n_frequent_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_frequent_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_frequent_words > 0 AND n_words - n_frequent_words < 20) AS kept
FROM m
"""
