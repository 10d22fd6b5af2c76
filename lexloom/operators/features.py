"""Pattern features: statistics of splits and context, punctuation, stop words, completeness, tags.

Every function takes patterns (gram, n, freq) and gives a row per pattern; what is missing counts as zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import flags, mining
from .annotate import GROUP_NAMES, STOPWORDS, TAG_GROUPS

EPSILON = 1e-8


def probability(patterns: DataFrame, n_tokens: Column) -> Column:
    """(freq + epsilon) x n / tokens for multi-word patterns; freq / tokens for single words."""
    return F.when(F.col("n") > 1, (F.col("freq") + EPSILON) * F.col("n") / n_tokens).otherwise(F.col("freq") / n_tokens)


def with_probability(patterns: DataFrame, toks: DataFrame) -> DataFrame:
    total = toks.agg(F.count("*").alias("n_tokens"))
    return patterns.crossJoin(F.broadcast(total)).withColumn("prob", probability(patterns, F.col("n_tokens"))).drop("n_tokens")  # one row beside each


def best_split(patterns: DataFrame) -> DataFrame:
    """gram, f1, f2, f4 of multi-word patterns (with prob) at the split whose halves are likeliest; the first wins ties.

    f1 = P(g) / P(left)P(right), f2 = freq / sqrt(freq left) / sqrt(freq right), f4 = freq ln f1.
    """
    parts = patterns.where("n > 1").select("gram", "freq", "prob", F.split("gram", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("cut"))
    halves = parts.select("gram", "freq", "prob", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left_gram"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")), " ").alias("right_gram"))
    side = lambda s: patterns.select(F.col("gram").alias(f"{s}_gram"), F.col("freq").alias(f"{s}_freq"), F.col("prob").alias(f"{s}_prob"))
    both = halves.join(side("left"), "left_gram").join(side("right"), "right_gram").withColumn("p", F.col("left_prob") * F.col("right_prob"))
    top = both.groupBy("gram").agg(F.max_by(F.struct("freq", "prob", "p", "left_freq", "right_freq"), F.struct("p", -F.col("cut"))).alias("b"))
    f1 = F.try_divide("b.prob", "b.p")
    return top.select("gram", f1.alias("f1"), (F.col("b.freq") / F.sqrt(F.col("b.left_freq") + EPSILON) / F.sqrt(F.col("b.right_freq") + EPSILON)).alias("f2"), (F.col("b.freq") * F.log(f1)).alias("f4"))


def _summed(found, words, hashes, n: int, sums: dict):
    """Of the places where the grams of n words in a row begin: an Arrow batch of each gram, n, the number k of its places and the sums over them."""
    import numpy as np
    import pyarrow as pa

    _, first, which = np.unique(hashes[found], return_index=True, return_inverse=True)
    total = lambda x: pa.array(np.bincount(which, x, len(first)).astype(np.int64))
    cols = [mining._joined(words, found[first], n), pa.array(np.full(len(first), n, np.int32)), total(np.ones(len(found))), *map(total, sums.values())]
    return pa.RecordBatch.from_arrays(cols, ["gram", "n", "k", *sums])


def context_outside(patterns: DataFrame, texts: DataFrame, idf: DataFrame, max_len: int = 5) -> DataFrame:
    """gram, outside: how often a pattern's words stand in the sentences around its occurrences beyond the pattern itself, idf-weighted.

    texts: lines (the tokens of each line) of a document in its row, as annotate.texts has them; what is around a
    sentence lies in its document, so sums per pattern are made in one narrow pass and only they travel.
    """
    patterns = patterns.where("n > 1")
    held = texts.sparkSession.sparkContext.broadcast(mining._filter(patterns))
    places = [f"s{j}" for j in range(max_len)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for b in batches:
            step = max(1, int(b.num_rows * 400_000 / (len(b.column(0).flatten().flatten()) + 1)))
            for docs in (b.column(0).slice(i, step) for i in range(0, b.num_rows, step)):
                lines = docs.flatten()
                words, h, offsets = mining._hashed(lines)
                doc = np.repeat(np.arange(len(docs)), docs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(len(lines)) + doc, np.diff(offsets))  # a free line between documents
                coded = words.dictionary_encode()
                key = row * (kinds := len(coded.dictionary) or 1) + coded.indices.to_numpy(zero_copy_only=False)
                known, back, count = np.unique(key, return_inverse=True, return_counts=True)
                seen = count.copy()
                for other in (known - kinds, known + kinds):
                    at = np.minimum(np.searchsorted(known, other), max(len(known) - 1, 0))
                    seen += np.where(known[at] == other, count[at], 0)
                around = seen[back]
                for n, g, fits in mining._gram_hashes(h, offsets, max_len):
                    if n > 1 and len(at := np.flatnonzero(fits & mining._marked(held.value, g))):
                        yield _summed(at, words, g, n, {c: around[at + j] if j < n else np.zeros(len(at)) for j, c in enumerate(places)})

    sums = texts.select("lines").mapInArrow(run, "gram string, n int, k long, " + ", ".join(f"{c} long" for c in places)).groupBy("gram").agg(F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in places])
    per = sums.join(patterns.select("gram"), "gram", "left_semi").select("gram", "k", F.posexplode(F.split("gram", " ")).alias("j", "token"), F.array(*places).alias("s"))
    # the places of a word in the gram all see the same sum
    each = per.groupBy("gram", "token", "k").agg(F.count("*").alias("times"), F.max(F.get("s", F.col("j"))).alias("s")).join(idf.select("token", "idf"), "token")
    extra = (F.col("s") - F.col("times") * F.col("k")) / F.col("k")
    return each.groupBy("gram").agg((F.sum(F.col("times") * F.col("idf") * extra) / F.sum(F.col("times") * F.col("idf"))).alias("outside"))


def _flags(surfaces, tokens, offsets):
    """The flags of flags.token_flags that the ratios need, for all tokens of an Arrow batch in a row."""
    import unicodedata

    import numpy as np

    def of(words, *tests):
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        return [np.array([t(w) for w in coded.dictionary.to_pylist()], bool)[at] for t in tests]

    upper = lambda w: w.upper() == w and any(map(str.isalpha, w))
    punc, capital, every = of(surfaces, lambda w: not any(map(str.isalnum, w)), lambda w: upper(w) or unicodedata.category(w[0]) == "Lu", upper)
    quote, closing, tick, dash, opening, shut = of(tokens, *[lambda w, x=x: w in x for x in (flags.QUOTES, ('"', "''"), ("``",), ("-",), ("(",), (")",))])
    place, starts = np.arange(len(punc)), np.repeat(offsets[:-1], np.diff(offsets))
    here = np.maximum.accumulate(np.where(punc, place, -1)) if len(place) else place  # the last punctuation up to a token
    before = np.concatenate([[-1], here])[: len(place)]
    last = lambda flag, at: (at >= starts) & flag[at]
    ends = np.repeat(offsets[1:], np.diff(offsets)) == place + 1
    following = lambda flag: ~ends & np.append(flag, False)[1:]
    return {
        "quote_before": ~punc & last(quote, before),
        "quote_after": following(punc & closing) | (following(punc) & last(tick, here)),
        "dash_after": following(punc & dash),
        "paren_before": ~punc & last(opening, before),
        "paren_after": following(punc & shut),
        "first_capital": ~punc & capital,
        "all_capital": ~punc & every,
    }


def punctuation_ratios(patterns: DataFrame, sents: DataFrame, max_len: int = 5) -> DataFrame:
    """gram, n, quote, dash, parenthesis, first_cap, all_cap: shares of a pattern's occurrences that the flags mark.

    One narrow pass over sentences (surfaces, tokens): occurrences meet the flags of their own sentence, and only sums per pattern travel.
    """
    held = sents.sparkSession.sparkContext.broadcast(mining._filter(patterns))
    names = {"q": "quote", "d": "dash", "p": "parenthesis", "c": "first_cap", "a": "all_cap"}

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for b in mining._merged(batches):
            words, h, offsets = mining._hashed(b.column(0))
            f = _flags(b.column(1).flatten(), words, offsets)
            upto = {c: np.concatenate([[0], np.cumsum(f[c])]) for c in ("dash_after", "first_capital", "all_capital")}
            for n, g, fits in mining._gram_hashes(h, offsets, max_len):
                at = np.flatnonzero(fits & mining._marked(held.value, g))
                if not len(at):
                    continue
                marked = lambda c, end: upto[c][end] - upto[c][at]  # noqa: B023, E731
                yield _summed(at, words, g, n, {
                    "q": f["quote_before"][at] & f["quote_after"][at + n - 1],
                    "d": marked("dash_after", at + n - 1) > 0,
                    "p": f["paren_before"][at] & f["paren_after"][at + n - 1],
                    "c": marked("first_capital", at + n) == n,
                    "a": marked("all_capital", at + n) == n,
                })

    sums = sents.select("tokens", "surfaces").mapInArrow(run, "gram string, n int, k long, " + ", ".join(f"{c} long" for c in names))
    per = sums.groupBy("gram", "n").agg(F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in names]).join(patterns.select("gram"), "gram", "left_semi")
    return per.select("gram", "n", *[(F.col(c) / F.col("k")).alias(name) for c, name in names.items()])


def stopword_features(patterns: DataFrame, idf: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """gram, stop_first, stop_last, stop_ratio, avg_idf; first and ratio count digits as stop words too."""
    words = patterns.select("gram", "n", F.posexplode(F.split("gram", " ")).alias("j", "token")).join(idf.select("token", "idf"), "token", "left")
    stop = F.col("token").isin(*stopwords)
    wide = stop | F.col("token").rlike("^[0-9]+$")
    at = lambda c, k: F.max(F.when(F.col("j") == k, c.cast("int")).otherwise(0))
    return words.groupBy("gram", "n").agg(at(wide, 0).alias("stop_first"), at(stop, F.col("n") - 1).alias("stop_last"), F.avg(wide.cast("int")).alias("stop_ratio"), F.avg(F.coalesce("idf", F.lit(0.0))).alias("avg_idf"))


def completeness(patterns: DataFrame) -> DataFrame:
    """gram, n, complete_sub = freq / max(freq, freq of prefix, of suffix) (multi-word), complete_super = greatest freq of a one-word extension / freq."""
    w = F.split("gram", " ")
    longer = patterns.where("n > 1").select("freq", F.explode(F.array(F.array_join(F.slice(w, 1, F.col("n") - 1), " "), F.array_join(F.slice(w, 2, F.col("n") - 1), " "))).alias("gram"))
    above = longer.groupBy("gram").agg(F.max("freq").alias("super_freq"))
    parts = patterns.where("n > 1").select(F.col("gram").alias("whole"), F.explode(F.array(F.array_join(F.slice(w, 1, F.col("n") - 1), " "), F.array_join(F.slice(w, 2, F.col("n") - 1), " "))).alias("gram"))
    below = parts.join(patterns.select("gram", "freq"), "gram").groupBy(F.col("whole").alias("gram")).agg(F.max("freq").alias("sub_freq"))
    return patterns.join(above, "gram", "left").join(below, "gram", "left").select("gram", "n", F.when(F.col("n") > 1, F.coalesce(F.try_divide(F.col("freq"), F.greatest("freq", F.coalesce("sub_freq", F.lit(0)))), F.lit(0.0))).alias("complete_sub"), F.coalesce(F.try_divide(F.coalesce("super_freq", F.lit(0)), F.col("freq")), F.lit(0.0)).alias("complete_super"))


def tag_group(tag: Column) -> Column:
    out = F.lit("NA")
    for name, tags in TAG_GROUPS.items():
        out = F.when(tag.isin(*tags), name).otherwise(out)
    return out


def pos_ratios(tags: DataFrame) -> DataFrame:
    """gram and the share of each tag group among a pattern's tags (gram, tags)."""
    groups = F.transform(F.split("tags", " "), tag_group)
    share = lambda k: F.size(F.filter("g", lambda x: x == F.lit(k))) / F.size("g")
    return tags.withColumn("g", groups).select("gram", *[share(k).alias(f"pos_{k.lower()}") for k in GROUP_NAMES])


def tag_bigrams(tags: DataFrame, buckets: list[tuple[str, str]]) -> DataFrame:
    """gram and, for each tag pair, 1 if the pattern's tags hold it in a row."""
    return tags.select("gram", *[F.concat(F.lit(" "), "tags", F.lit(" ")).contains(f" {a} {b} ").cast("int").alias(f"has_{a}_{b}".lower()) for a, b in buckets])


def unigram_features(patterns: DataFrame, sents: DataFrame, idf: DataFrame) -> DataFrame:
    """Features of single words: log_freq, independent (share of the word's tokens in the best segmentation: freq over all), stop, idf, quote, parenthesis, first_cap, all_cap, complete_super."""
    one = patterns.where("n = 1")
    raw = sents.select(F.explode("tokens").alias("gram")).groupBy("gram").agg(F.count("*").alias("total"))
    ratios = punctuation_ratios(one, sents, 1).select("gram", "quote", "parenthesis", "first_cap", "all_cap")
    stop = (F.col("gram").isin(*STOPWORDS) | F.col("gram").rlike("^[0-9]+$")).cast("int")
    return (
        one.join(raw, "gram").join(idf.select(F.col("token").alias("gram"), "idf"), "gram").join(ratios, "gram", "left").join(completeness(patterns).where("n = 1").select("gram", "complete_super"), "gram")
        .select("gram", F.log(F.col("freq") + 1.0).alias("log_freq"), (F.col("freq") / F.col("total")).alias("independent"), stop.alias("stop"), "idf", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("quote", "parenthesis", "first_cap", "all_cap")], "complete_super")
    )


def multiword_matrix(patterns: DataFrame, sents: DataFrame, texts: DataFrame, idf: DataFrame, tags: DataFrame, max_len: int = 5) -> DataFrame:
    """All 25 features of the multi-word patterns, zero where undefined (also for external patterns)."""
    many = patterns.where("n > 1").select("gram")
    tables = [
        best_split(patterns).select("gram", "f1", "f2", "f4"),
        context_outside(patterns, texts, idf, max_len),
        punctuation_ratios(patterns.where("n > 1"), sents, max_len).select("gram", "quote", "dash", "parenthesis", "first_cap"),
        stopword_features(patterns.where("n > 1"), idf).select("gram", "stop_first", "stop_last", "stop_ratio", "avg_idf"),
        completeness(patterns).where("n > 1").select("gram", "complete_sub", "complete_super"),
        pos_ratios(tags),
    ]
    return reduce(lambda a, b: a.join(b, "gram", "left"), tables, many).na.fill(0)
