"""Frequent n-grams within sentences: mining, pruning, occurrences, tags, external patterns."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..storage import stored

MIN_SUP, MAX_LEN = 10, 5
#: Bits of the filters that tell workers which grams are frequent: 2 MB each.
SLOT_BITS = 24


def spans(words: Column, max_len: int) -> Column:
    """(n, st, gram) of all n-grams of an array, n up to max_len; a gram is its words joined by blanks."""

    def within(w: Column) -> Column:
        of = lambda n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(n.alias("n"), i.alias("st"), F.array_join(F.slice(w, i + 1, n), " ").alias("gram")))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_len), F.size(w))), of))

    return let(words, within)


def all_grams(sents: DataFrame, max_len: int = MAX_LEN, words: str = "tokens") -> DataFrame:
    """sent_id, n, st, gram: every n-gram of every sentence."""
    return sents.select("sent_id", F.explode(spans(F.col(words), max_len)).alias("x")).select("sent_id", "x.n", "x.st", "x.gram")


def _hashed(lists, salt: bytes = b""):
    """Of an Arrow array of word lists: the words in a row, their 64-bit hashes (others by another salt), and the offsets of the lists."""
    import numpy as np

    words = lists.flatten()
    coded = words.dictionary_encode()
    distinct = [int.from_bytes(blake2b(w.encode(), digest_size=8, salt=salt).digest(), "little") for w in coded.dictionary.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words, np.array(distinct, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)], offsets


def _gram_hashes(hashes, offsets, max_len: int) -> Iterator:
    """For n = 1..max_len: the hash of the n words from each place on, and whether they end within their list."""
    import numpy as np

    ends, h = np.repeat(offsets[1:], np.diff(offsets)), hashes.copy()
    place = np.arange(len(h))
    for n in range(1, max_len + 1):
        if 1 < n <= len(h):
            x = h[: len(h) - n + 1]
            h[: len(x)] = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :]
        yield n, h, place + n <= ends


def _slots(h):
    import numpy as np

    x = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _marked(bits, h):
    """Which hashes a filter holds (others with a small chance)."""
    import numpy as np

    s = _slots(h)
    return (bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1


def _filter(grams: DataFrame):
    """A bit for each gram's hash. Its size is fixed, whatever the number of grams: more grams only mean more false hits."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            _, h, offsets = _hashed(pc.split_pattern(b.column(0), " "))
            size = np.diff(offsets)
            own = np.zeros(len(size), np.uint64)
            for n, g, _ in _gram_hashes(h, offsets, int(size.max())):
                at = np.flatnonzero(size == n)
                own[at] = g[offsets[:-1][at]]
            s = np.unique(_slots(own))
            k, first = np.unique(s >> 6, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (s & 63).astype(np.uint64), first).view(np.int64))], ["k", "v"])

    rows = grams.select("gram").mapInArrow(run, "k long, v long").groupBy("k").agg(F.bit_or("v").alias("v")).toPandas()  # at most 2^SLOT_BITS / 64
    bits = np.zeros(1 << SLOT_BITS >> 6, np.uint64)
    bits[rows["k"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).view(np.uint64)
    return bits


def _level(sents: DataFrame, words: str, n: int, known) -> DataFrame:
    """gram, freq of the n-grams of a batch whose halves of n - 1 words the filter holds."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits = None if known is None else known.value
        for b in _merged(batches):
            w, h, offsets = _hashed(b.column(0))
            ok = None
            for k, g, fits in _gram_hashes(h, offsets, n):
                if k == n - 1:
                    ok = np.append(fits & _marked(bits, g), False)
            at = np.flatnonzero(fits if ok is None else fits & ok[:-1] & ok[1:])
            _, first, count = np.unique(g[at], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_joined(w, at[first], n), pa.array(count)], ["gram", "freq"])

    return sents.select(words).mapInArrow(run, "gram string, freq long")


def _merged(batches: Iterator) -> Iterator:
    """Batches of some hundred thousand words, so that counts are summed before they travel."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b.column(0).flatten()) if pa.types.is_list(b.column(0).type) else b.num_rows
        if size >= 400_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _joined(words, at, n: int):
    """The n words from each of the places on, joined by blanks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = [words.take(pa.array(at + j)) for j in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def frequent_grams(sents: DataFrame, min_sup: int = MIN_SUP, max_len: int = MAX_LEN, words: str = "tokens") -> DataFrame:
    """gram, n, freq of n-grams with support.

    Level by level: an n-gram is only counted where both its parts of n - 1 words are frequent, which a filter of fixed
    size tells each worker. So few rare grams are ever built, and counts are summed per batch before they travel.
    """
    spark = sents.sparkSession
    sents, known, out = stored(sents.select(words), "tokens"), None, None
    for n in range(1, max_len + 1):
        level = _level(sents, words, n, known).groupBy("gram").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= min_sup)
        level = stored(level.select("gram", F.lit(n).alias("n"), "freq"), f"grams-{n}")
        out = level if out is None else out.unionByName(level)
        if n < max_len:
            known = spark.sparkContext.broadcast(_filter(level))
    return out


def frequent_tag_grams(sents: DataFrame, min_sup: int = MIN_SUP, max_len: int = MAX_LEN) -> DataFrame:
    return frequent_grams(sents, min_sup, max_len, "tags")


def _found(sents: DataFrame, patterns: DataFrame, max_len: int, tags: bool) -> DataFrame:
    """sent_id, n, st, gram (and tags) of the places where a pattern may stand: those the patterns' filter holds."""
    held = sents.sparkSession.sparkContext.broadcast(_filter(patterns))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            w, h, offsets = _hashed(b.column(1))
            sent, start = b.column(0).to_numpy(), offsets[:-1]
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            marks = b.column(2).flatten() if tags else None
            for n, g, fits in _gram_hashes(h, offsets, max_len):
                at = np.flatnonzero(fits & _marked(held.value, g))
                st = at - start[row[at]]
                if tags:  # a batch says the first place of a gram only
                    order = np.lexsort((st, sent[row[at]], g[at]))
                    order = order[np.diff(g[at][order], prepend=g[at][order][:1] ^ np.uint64(1)) != 0]
                    at, st = at[order], st[order]
                cols = [pa.array(sent[row[at]]), pa.array(np.full(len(at), n, np.int32)), pa.array(st.astype(np.int32)), _joined(w, at, n)]
                yield pa.RecordBatch.from_arrays(cols + ([_joined(marks, at, n)] if tags else []), ["sent_id", "n", "st", "gram", "tags"][: 4 + tags])

    return sents.select("sent_id", "tokens", *["tags"] * tags).mapInArrow(run, "sent_id long, n int, st int, gram string" + ", tags string" * tags)


def unpruned_grams(sents: DataFrame, no_initial: tuple[str, ...], no_expansion: tuple[str, ...], max_len: int = MAX_LEN) -> DataFrame:
    """sent_id, n, st, gram of the occurrences that tags allow: the first token's tag not in both lists, no later token's in no_expansion."""
    both = tuple(set(no_initial) & set(no_expansion))
    tagged = all_grams(sents.withColumn("w", F.zip_with("tokens", "tags", lambda a, b: F.struct(a.alias("t"), b.alias("g")))).withColumn("tokens", F.transform("w", lambda x: F.concat_ws("\x01", x["t"], x["g"]))), max_len)
    parts = tagged.withColumn("w", F.split("gram", " "))
    tag = lambda x: F.substring_index(x, "\x01", -1)
    ok = ~tag(F.get("w", 0)).isin(*both) & ~F.exists(F.slice("w", 2, max_len), lambda x: tag(x).isin(*no_expansion))
    return parts.where(ok).select("sent_id", "n", "st", F.array_join(F.transform("w", lambda x: F.substring_index(x, "\x01", 1)), " ").alias("gram"))


def occurrences(sents: DataFrame, patterns: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """gram, n, sent_id, st, ed (inclusive) of the given patterns."""
    found = _found(sents, patterns, max_len, False).join(patterns.select("gram"), "gram", "left_semi")
    return found.select("gram", "n", "sent_id", "st", (F.col("st") + F.col("n") - 1).alias("ed"))


def first_tags(sents: DataFrame, patterns: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """gram, tags: the tags of each pattern's first occurrence, by sentence and place."""
    found = _found(sents, patterns, max_len, True).join(patterns.select("gram"), "gram", "left_semi")
    return found.groupBy("gram").agg(F.min_by("tags", F.struct("sent_id", "st")).alias("tags"))


def with_external(patterns: DataFrame, external: DataFrame, min_sup: int = MIN_SUP, max_len: int = MAX_LEN) -> DataFrame:
    """Mined patterns and the external ones that were not mined (at most max_len words), at the least support."""
    extra = external.select("gram", F.size(F.split("gram", " ")).alias("n")).distinct().where(F.col("n") <= max_len).join(patterns, "gram", "left_anti")
    return patterns.select("gram", "n", "freq").unionByName(extra.withColumn("freq", F.lit(min_sup).cast("long")))
