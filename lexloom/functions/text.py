"""Scalar functions over columns: tokens, case codes, tagged words, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A run of letters and digits, or any other single character that is no blank.
TOKEN = r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, even where body uses it for every element of something else."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenize(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1))


def split_nonempty(x: Column, separator: str) -> Column:
    """Parts between separators, empty ones left out."""
    return F.filter(F.split(x, f"\\Q{separator}\\E"), lambda p: p != "")


def is_punctuation(token: Column) -> Column:
    return ~token.rlike(r"[\p{L}\p{N}]")


def is_numeric_id(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def is_number(token: Column) -> Column:
    """Whether the text reads as a floating-point number."""
    return token.try_cast("double").isNotNull()


def case_code(word: Column) -> Column:
    """3: all upper case, or punctuation or empty; 1: first letter upper case; 4: digits; 0: otherwise (the first that holds)."""
    upper = (F.upper(word) == word) & word.rlike(r"\p{L}")
    first = F.substring(word, 1, 1)
    return F.when(upper | is_punctuation(word), 3).when(first.rlike(r"^\p{Lu}"), 1).when(word.rlike("^[0-9]+$"), 4).otherwise(0)


def case_bits(word: Column) -> Column:
    """Digit bit (4), all-upper bit (2) and first-upper bit (1); punctuation is 3."""
    digit = word.rlike("^[0-9]+$").cast("int")
    upper = ((F.upper(word) == word) & word.rlike(r"\p{L}")).cast("int")
    first = F.substring(word, 1, 1).rlike(r"^\p{Lu}").cast("int")
    return F.when(is_punctuation(word), 3).otherwise(F.shiftleft(digit, 2).bitwiseXOR(F.shiftleft(upper, 1)).bitwiseXOR(first))


def tagged_word(x: Column) -> Column:
    """(word, tag) of word_TAG; the last underscore parts them."""
    return F.struct(F.regexp_extract(x, "^(.*)_([^_]*)$", 1).alias("word"), F.regexp_extract(x, "^(.*)_([^_]*)$", 2).alias("tag"))


def with_index(words: Column) -> Column:
    """Every word behind its place: 0_the 1_cat."""
    return F.transform(words, lambda w, i: F.concat_ws("_", i.cast("string"), w))


def ascii_only(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\x00-\x7F]", "")


def underscored(phrase: Column) -> Column:
    return F.regexp_replace(phrase, " ", "_")


def without_labels(segmented: Column) -> Column:
    """Lower-case words of 'a b:EP]_[c:RP' style text with phrases as one word, for word-vector training."""
    plain = F.regexp_replace(segmented, ":(EP|RP|BP)", "")
    return F.lower(F.array_join(F.transform(F.split(plain, r"\]_\["), lambda x: F.regexp_replace(F.trim(x), " ", "_")), " "))


def drop_first_field(line: Column) -> Column:
    return F.ltrim(F.get(F.split(line, "\t"), 1))


def surface_for_pronouns(lemmas: Column, surfaces: Column, lemmas_kept: tuple[str, ...] = ("he", "she", "you")) -> Column:
    """Lemmas, but the surface form where the lemma is one of the pronouns."""
    return F.zip_with(lemmas, surfaces, lambda a, b: F.when(a.isin(*lemmas_kept), b).otherwise(a))


def adjusted_score(score: Column, predicate: Column, bonus: float = 3.0, parts: int = 4) -> Column:
    """A long predicate (more than ``parts`` words joined by underscores) scores ``bonus`` more."""
    return F.when(F.size(F.split(predicate, "_")) > parts, score + bonus).otherwise(score)


def sentences_of(text: Column) -> Column:
    """Sentences: cut behind full stops and runs of !?;: ; tabs, line ends and underscores become blanks."""
    clean = F.regexp_replace(text, r"[\t\n\r_]", " ")
    return F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"([^.!?;:]*(?:\.|[!?;:]+|$))"), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")


def log_safe(x: Column, epsilon: float = 1e-8) -> Column:
    return F.log(x + epsilon)


def sign(x: Column, epsilon: float = 1e-8) -> Column:
    return F.when(x > epsilon, 1).when(x < -epsilon, -1).otherwise(0)
