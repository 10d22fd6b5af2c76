"""Distant supervision: entity and relation phrases of a tagged corpus, and links to dictionaries and seeds."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .mentions import chunk_spans

#: Relation phrases over a tag string: verb, words, preposition; verb, preposition; verb; noun, preposition.
_V, _W, _P, _N = r"((VB|VBD|VBG|VBN|VBP|VBZ) )+", r"((NN.{0,2}|JJ.{0,1}|RB.{0,1}|PRP.{0,1}|DT ))+", r"((IN|RP) +)", r"(NN.{0,2})+"
RELATION = f"({_V}{_W}{_P}|{_V}{_P}|{_V}|{_N}{_P})"
_FIRST, _FIRST_AT = re.compile(RELATION).search, re.compile(RELATION).match


def frequent_phrases(phrases: DataFrame, more_than: int = 9) -> DataFrame:
    """text, freq of phrases that occur more than ``more_than`` times (times, where a row stands for several)."""
    count = F.sum("times") if "times" in phrases.columns else F.count("*")
    return phrases.groupBy("text").agg(count.alias("freq")).where(F.col("freq") > more_than)


#: A verb's tag, and the places of nouns and prepositions that may make up a noun phrase with preposition.
_VERBS, _NOUN, _LINK = (re.compile(x) for x in (r"(?:VB|VBD|VBG|VBN|VBP|VBZ) ", "NN", r"(?:IN|RP) "))


def _first_matches(said: str) -> list[tuple[int, int]]:
    """(start, least end) of every place where a relation phrase can begin: a verb's tag, or a noun from which nouns lead to a preposition.

    The ends never fall from one start to the next: nouns that lead to a preposition hold no verb, and all end with it.
    """
    link, lead = {m.start(): m.end() for m in _LINK.finditer(said)}, {}
    for p in [m.start() for m in _NOUN.finditer(said)][::-1]:
        ends = [e for q in range(p + 2, p + 5) if (e := link.get(q) or lead.get(q))]
        if ends:
            lead[p] = min(ends)
    return sorted([*lead.items(), *((m.start(), m.end()) for m in _VERBS.finditer(said))])


def phrases_between(tags: list[str], spans: list[tuple[int, int]], legacy: bool = False) -> list[tuple[int, int, int]]:
    """(first word, words, times) of the first relation phrase between two spans (start, past the end) that do not overlap, counted over all pairs.

    The first phrase of a gap begins at the first place where one can and that leaves it room, which depends on the gap's
    beginning alone; how far it reaches depends on the gap's end alone, and only on ends before the phrase is whole. So each
    place is matched once for all gaps that lead to it, its changes are found by bisection, and pairs are counted, not visited.
    """
    starts = [0]
    for t in tags:
        starts.append(starts[-1] + len(t) + 1)
    said = "".join([f"{t} " for t in tags])
    first = _first_matches(said)
    begins = [p for p, _ in first]
    from_place: dict[int, int] = {}
    for _, end in spans:
        if (k := bisect_left(begins, starts[end])) < len(first):
            from_place[k] = from_place.get(k, 0) + 1
    rights = sorted(s for s, _ in spans)
    stops = [starts[s] - legacy for s in rights]
    out = []
    for k, lefts in from_place.items():
        place, least = first[k]
        j = bisect_left(stops, least)
        while j < len(stops):
            start, past = _FIRST_AT(said, place, stops[j]).span()
            last, step = j, len(stops) - 1
            while last < step:  # the last span behind which the match is still this one
                mid = (last + step + 1) // 2
                if _FIRST_AT(said, place, stops[mid]).end() == past:
                    last = mid
                else:
                    step = mid - 1
            word = bisect_right(starts, start) - 1
            out.append((word, bisect_right(starts, start + len(said[start:past].rstrip()) - 1) - word, lefts * (last - j + 1)))
            j = last + 1
    return out


def relation_phrases(sents: DataFrame, legacy: bool = False) -> DataFrame:
    """sent_id, text, tags, times: the first relation phrase of the gaps between chunks i < j of a sentence that do not overlap,
    whatever the gap's length, and the number of such pairs. sents: sent_id, tokens, tags and, if others than the noun chunks are meant, chunks (st, n).

    The tags of a gap end with a blank, so that its last tag can match; ``legacy`` leaves it out. One narrow pass.
    """
    given = "chunks" in sents.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            chunks = b.column(3).to_pylist() if given else [None] * b.num_rows
            for sent, tokens, tags, own in zip(*(b.column(i).to_pylist() for i in range(3)), chunks):
                spans = [(c["st"], c["st"] + c["n"]) for c in own or []] if given else chunk_spans(tags or [])
                for first, n, times in phrases_between(tags, spans, legacy) if len(spans) > 1 else ():
                    rows.append((sent, " ".join(tokens[first : first + n]), " ".join(tags[first : first + n]), times))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["sent_id", "text", "tags", "times"])

    return sents.select("sent_id", "tokens", "tags", *["chunks"] * given).mapInArrow(run, "sent_id long, text string, tags string, times long")


def linked_by_dictionary(sents: DataFrame, dictionary: DataFrame, max_len: int = 5) -> DataFrame:
    """sent_id, st, ed, gram: every n-gram of a sentence that the dictionary holds."""
    from .mining import occurrences

    return occurrences(sents, dictionary.select("gram").distinct(), max_len).select("sent_id", "st", "ed", "gram")


def confident_seeds(seeds: DataFrame, sim: float = 0.8, second: float = 0.001) -> DataFrame:
    return seeds.where((F.col("sim") > sim) & (F.col("second_rank") < second))


def linked_by_seed(sents: DataFrame, seeds: DataFrame, max_len: int = 5) -> DataFrame:
    """sent_id, st, ed, gram: where a confident seed's surface stands in a sentence of its document. sents: also doc_id."""
    from .mining import occurrences

    s = confident_seeds(seeds).select(F.col("doc").alias("doc_id"), F.lower("surface").alias("gram")).distinct()
    found = occurrences(sents, s.select("gram").distinct(), max_len).join(sents.select("sent_id", "doc_id"), "sent_id")
    return found.join(s, ["doc_id", "gram"], "left_semi").select("sent_id", "st", "ed", "gram")


def frequency_bands(phrases: DataFrame, multi: int = 5, low: int = 30, high: int = 100) -> DataFrame:
    """text, freq: phrases of several words seen ``multi`` times at least, and others between ``low`` and ``high`` (both exclusive)."""
    f = phrases.groupBy("text").agg(F.count("*").alias("freq"))
    return f.where(((F.col("freq") >= multi) & F.col("text").contains(" ")) | ((F.col("freq") > low) & (F.col("freq") < high)))


def noun_tag_patterns(tag_grams: DataFrame, top: int = 200) -> DataFrame:
    """gram, freq: of the ``top`` most frequent tag n-grams those with a noun and no verb."""
    return tag_grams.orderBy(F.desc("freq"), "gram").limit(top).where(F.col("gram").contains("N") & ~F.col("gram").contains("V"))


def linked_types(links: DataFrame, ids: DataFrame, types: DataFrame) -> DataFrame:
    """doc, surface, types: knowledge-base types of linked entities (uri -> kb_id -> types), those without left out."""
    t = types.groupBy("kb_id").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return links.join(ids, "uri").join(t, "kb_id").select("doc", "surface", "types")


def aligned_sentences(rows: DataFrame, seeds: DataFrame, least: float = 0.6) -> DataFrame:
    """row_id, sent_id: for each row (row_id, doc, words) the sentence of its document that shares the most of its words, if over ``least``."""
    both = rows.join(seeds.select("doc", "sent_id", F.col("words").alias("w")), "doc")
    s = F.size(F.array_intersect("words", "w")) / F.greatest(F.size(F.array_distinct("words")), F.lit(1))
    return both.withColumn("s", s).where(F.col("s") > least).groupBy("row_id").agg(F.max_by("sent_id", F.struct("s", -F.col("sent_id"))).alias("sent_id"))
