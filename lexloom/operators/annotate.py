"""Sentences and tokens of a document table, with rule-made tags and heads where no annotator's are given.

A line of a text is a sentence. Everything up to sentence arrays is a narrow transformation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_punctuation, let, tokenize

#: Fixed word lists of the rule tagger.
DETERMINERS = ("the", "a", "an", "this", "that", "le", "la", "les", "un", "une", "der", "die", "das", "el", "los", "las")
PREPOSITIONS = ("of", "in", "on", "with", "by", "for", "from", "at", "as", "de", "en", "par", "pour", "von", "mit", "que")
CONJUNCTIONS = ("and", "or", "et", "und", "y", "ou")
PRONOUNS = ("it", "he", "she", "they", "i", "you", "se", "sich")
AUXILIARIES = ("is", "was", "be", "are", "est", "ist")
STOPWORDS = DETERMINERS + PREPOSITIONS + CONJUNCTIONS + PRONOUNS + AUXILIARIES + ("to",)
#: Tag groups of the ratio features, by the order of their names; a tag without group is NA.
TAG_GROUPS = {"ADJ": ("JJ",), "CC": ("CC",), "CD": ("CD",), "DT": ("DT",), "IN": ("IN",), "NP": ("NN", "NNS", "NNP", "NNPS"), "PART": ("RP", "TO"), "PRP": ("PRP", "PRP$"), "RB": ("RB",), "VB": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")}
GROUP_NAMES = ("ADJ", "CC", "CD", "DT", "IN", "NA", "NP", "PART", "PRP", "RB", "VB")
SENT = 100_000  #: sent_id = doc_id * SENT + line number


def rule_tag(surface: Column, token: Column, pos: Column) -> Column:
    """A deterministic part-of-speech tag from word lists, suffixes, digits and capitals."""
    small = (surface >= "a") & (surface < "{")  # begins with one of a to z, as most do: no pattern needs to be matched
    listed = F.when(token == "to", "TO").when(token.isin(*DETERMINERS), "DT").when(token.isin(*PREPOSITIONS), "IN").when(token.isin(*CONJUNCTIONS), "CC").when(token.isin(*PRONOUNS), "PRP").otherwise("VBZ")
    return (
        F.when(~small & is_punctuation(surface), ".")
        .when(~small & surface.rlike("^[0-9]+$"), "CD")
        .when(token.isin(*STOPWORDS), listed)
        .when(token.endswith("ed"), "VBD")
        .when(token.endswith("ing"), "VBG")
        .when(token.endswith("ly"), "RB")
        .when(token.endswith("ble"), "JJ")
        .when((pos > 0) & ~small & surface.rlike(r"^\p{Lu}"), "NNP")
        .when(token.endswith("s"), "NNS")
        .otherwise("NN")
    )


def sentences(docs: DataFrame) -> DataFrame:
    """sent_id, surfaces, tokens (lower case), tags: a row per line with a token."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).select((F.col("doc_id") * SENT + F.col("line")).alias("sent_id"), tokenize(F.col("s")).alias("surfaces"))
    lower = lines.where(F.size("surfaces") > 0).withColumn("tokens", F.transform("surfaces", F.lower))
    return lower.withColumn("tags", F.transform(F.arrays_zip("surfaces", "tokens"), lambda x, i: rule_tag(x["surfaces"], x["tokens"], i)))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, lines: the tokens (lower case) of each line of a document, in its row; for what looks at neighbouring lines."""
    return docs.where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda s: F.transform(tokenize(s), F.lower)).alias("lines"))


def texts_of(sents: DataFrame) -> DataFrame:
    """doc_id, lines of sentences that stand in rows already (sent_id, tokens), gathered by document."""
    rows = sents.groupBy(F.floor(F.col("sent_id") / SENT).alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("sent_id") % SENT).cast("int"), "tokens"))).alias("m"))
    return rows.select("doc_id", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.element_at("m", i), F.array().cast("array<string>"))).alias("lines"))


def tokens(sents: DataFrame) -> DataFrame:
    """A row per token: sent_id, pos, surface, token, tag, is_punc."""
    return sents.select("sent_id", F.posexplode(F.arrays_zip("surfaces", "tokens", "tags")).alias("pos", "x")).select("sent_id", "pos", F.col("x.surfaces").alias("surface"), F.col("x.tokens").alias("token"), F.col("x.tags").alias("tag"), is_punctuation(F.col("x.surfaces")).alias("is_punc"))


def rule_heads(tags: Column) -> Column:
    """Heads (1-based, 0 the root) of a sentence: the last noun (else the first token) is the root; before it a token
    depends on the nearest noun after it, behind it on the token before. One root, no cycles."""
    nouns = F.filter(F.transform(tags, lambda t, i: F.when(t.startswith("NN"), i + 1)), lambda i: i.isNotNull())

    def heads(ns: Column, root: Column) -> Column:
        after = lambda i: F.try_element_at(F.filter(ns, lambda n: n > i + 1), F.lit(1))
        return F.transform(tags, lambda t, i: F.when(i + 1 == root, 0).when(i + 1 > root, i).otherwise(F.coalesce(after(i), root)))

    return let(nouns, lambda ns: let(F.coalesce(F.try_element_at(ns, F.lit(-1)), F.lit(1)), lambda root: heads(ns, root)))


def rule_dependencies(tags: Column) -> Column:
    """Dependencies of a sentence: nouns before a verb are its subjects, nouns behind one objects, else dep."""

    def within(g: Column) -> Column:
        kind = lambda t, i: F.when(t.startswith("NN") & F.exists(F.slice(g, i + 2, 3), lambda x: x.startswith("VB")), "nsubj").when(t.startswith("NN") & (i > 0) & F.exists(F.slice(g, F.greatest(i - 1, F.lit(1)), 2), lambda x: x.startswith("VB")), "dobj").otherwise("dep")
        return F.transform(F.arrays_zip(rule_heads(g).alias("h"), g.alias("t")), lambda x, i: F.struct(i.alias("idx"), x["h"].alias("head"), F.when(x["h"] == 0, "root").otherwise(kind(x["t"], i)).alias("type")))

    return let(tags, within)


def dependencies(tags: list[str]) -> tuple[list[int], list[str]]:
    """Heads and types of a sentence as rule_heads and rule_dependencies have them, in time in proportion to its length."""
    n = len(tags)
    noun, verb = [t.startswith("NN") for t in tags], [t.startswith("VB") for t in tags]
    root = max((i + 1 for i in range(n) if noun[i]), default=1)
    heads, after = [0] * n, root
    for i in range(n - 1, -1, -1):
        heads[i] = 0 if i + 1 == root else i if i + 1 > root else after
        after = i + 1 if noun[i] else after
    kind = lambda i: "nsubj" if any(verb[i + 1 : i + 4]) else "dobj" if i and any(verb[(at := max(i - 2, 0)) : at + 2]) else "dep"
    return heads, ["root" if not h else kind(i) if noun[i] else "dep" for i, h in enumerate(heads)]


def parsed_dependency(x: Column) -> Column:
    """idx, head, type of idx_head_type (or idx_head)."""
    p = F.split(x, "_", 3)
    return F.struct(F.get(p, 0).cast("int").alias("idx"), F.get(p, 1).cast("int").alias("head"), F.get(p, 2).alias("type"))


def zipped(words: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companion tables (sent_id, tokens) and (sent_id, tags) joined by sentence; second: the sentences whose lengths differ."""
    both = words.join(tags, "sent_id")
    return both.where(F.size("tokens") == F.size("tags")), both.where(F.size("tokens") != F.size("tags")).select("sent_id", F.size("tokens").alias("n_tokens"), F.size("tags").alias("n_tags"))
