"""Operator 1: substring deduplication by super-k-mers of words.

A window is ``window`` consecutive words. Its minimiser is the least hash among its ``minimiser``-word runs;
consecutive windows with one minimiser travel as one string, packed behind its occurrences, to the bucket of
that minimiser, so that equal windows always meet. There the windows of the bucket's strings are sorted by a
128-bit hash and each learns the least doc_id in which it starts. An occurrence in a later document marks
the words of the window for removal.

A block of texts sends each of its buckets one compressed row. Strings that repeat within a block are in it
once with at most ``listed`` occurrences; of more, the least and greatest doc_id go along. What the bucket finds about such a string returns by its hash to the
occurrences, in a join whose large keys Spark splits. So a passage that a third of all documents share costs
its bucket a row a block, not a row a document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, collect_garbage, only, parts, table, window_hashes, written

DEFAULTS = {"window": 13, "minimiser": 3, "listed": 8, "block_bytes": 4 << 20, "buckets": 16}


def _sliding_min(x, width: int):
    import numpy as np

    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def super_kmers(texts: list[bytes], o: dict):
    """Of a block of texts: minimiser, text's place, first word and string of every super-k-mer, in order."""
    import numpy as np
    import xxhash

    k, m = o["window"], o["minimiser"]
    split = [t.split() for t in texts]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in split], out=off[1:])
    n = int(off[-1])
    empty = np.zeros(0, np.int64)
    if n < k:
        return empty.view(np.uint64), empty, empty, empty, []
    words = [w for s in split for w in s]
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, n)
    least = _sliding_min(window_hashes(h, m), k - m + 1)
    valid = np.ones(n - k + 1, bool)
    for b in off[1:].tolist():  # windows that run past their text's end
        valid[max(0, b - k + 1) : b] = False
    same = np.zeros(len(valid), bool)
    same[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first = np.flatnonzero(valid & ~same)
    goes_on = np.append(same[1:], False)
    last = np.flatnonzero(valid & ~goes_on)
    at = np.zeros(n + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    joined = b" ".join(words)
    strings = [joined[a:b] for a, b in zip(at[first].tolist(), (at[last + k] - 1).tolist())]
    doc = np.searchsorted(off, first, side="right") - 1
    return least[first], doc, first - off[doc], last - first + 1, strings


def _grouped(strings: list[bytes]):
    """order, starts: the places of equal strings in a row, in their order of appearance."""
    import numpy as np
    import pyarrow as pa

    code = pa.array(strings, pa.binary()).dictionary_encode().indices.to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, starts


def _blocks(batches: Iterator, o: dict):
    """doc_ids, super-k-mers and their groups for each block of texts; rows without doc_id or text are out."""
    import numpy as np

    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for at, texts in chunks(b.column(1), o["block_bytes"]):
            key, doc, pos, n, strings = super_kmers(texts, o)
            if strings:
                yield np.asarray(ids[at : at + len(texts)], np.int64)[doc], key, pos, n, strings, *_grouped(strings)


def packed(docs: DataFrame, o: dict) -> DataFrame:
    """bucket, data: a block's super-k-mers of a bucket, compressed. Of each: length, count and flag, (least, greatest doc_id,) occurrences, string."""
    buckets = parts(docs.sparkSession, o["buckets"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        listed, squeeze = o["listed"], zstandard.ZstdCompressor(level=3).compress
        for ids, key, pos, _, strings, order, starts in _blocks(batches, o):
            ends = np.append(starts[1:], len(order))
            occurrence = np.zeros(len(order), [("d", "<i8"), ("p", "<u4")])
            occurrence["d"], occurrence["p"] = ids[order], pos[order]
            raw, out = occurrence.tobytes(), []
            low = np.minimum.reduceat(ids[order], starts).tolist()
            high = np.maximum.reduceat(ids[order], starts).tolist()
            for a, e, lo, hi, first in zip(starts.tolist(), ends.tolist(), low, high, order[starts].tolist()):
                s = strings[first]
                if e - a <= listed:
                    out.append(struct.pack("<IB", len(s) + 12 * (e - a) + 1, e - a) + raw[12 * a : 12 * e] + s)
                else:
                    out.append(struct.pack("<IBqq", len(s) + 12 * listed + 17, 128 + listed, lo, hi) + raw[12 * a : 12 * (a + listed)] + s)
            bucket = (key[order[starts]] % np.uint64(buckets)).astype(np.int32)
            dealt = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[dealt])) + 1
            groups = [dealt[a:e] for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dealt)])]
            rows = [squeeze(b"".join([out[i] for i in g.tolist()])) for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[[g[0] for g in groups]]), pa.array(rows, pa.binary())], ["bucket", "data"])

    return docs.mapInArrow(run, "bucket int, data binary")


def _resolve(rows: list[bytes], o: dict):
    """Of complete buckets: removed runs of the listed occurrences (doc_id, first, past the last word), and (hash, first windows' least doc_ids) of strings with more."""
    import numpy as np
    import xxhash

    k = o["window"]
    texts, doc, pos, row, low, more = [], [], [], [], [], []
    for i, x in enumerate(rows):
        n, at = x[0] & 127, 1
        if x[0] > 127:
            lo, hi = struct.unpack_from("<qq", x, 1)
            at = 17
            more.append((i, hi))
        occ = struct.unpack_from("<" + "qI" * n, x, at)
        doc += occ[::2]
        pos += occ[1::2]
        row += [i] * n
        low.append(lo if x[0] > 127 else min(occ[::2]))
        texts.append(x[at + 12 * n :])
    words = [t.split(b" ") for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for s in words for w in s), np.uint64, int(off[-1]))
    count = size - k + 1
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(off[:-1] - begin[:-1], count) + np.arange(begin[-1])  # places of windows that lie in one string
    one, two = window_hashes(h, k)[at], window_hashes(h ^ np.uint64(0x5851F42D4C957F2D), k, seed=7)[at]
    order = np.argsort(one)
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    if (new[1:] & (a[1:] == a[:-1])).any():  # two windows share the first half of the hash
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    starts = np.flatnonzero(new)
    each = np.repeat(np.array(low, np.int64), count)
    group = np.minimum.reduceat(each[order], starts)
    least = np.empty(len(order), np.int64)
    least[order] = group[np.cumsum(new) - 1]
    doc, pos, row = np.array(doc, np.int64), np.array(pos, np.int64), np.array(row, np.int64)
    lost = doc > np.minimum.reduceat(least, begin[:-1])[row]
    doc, pos, row = doc[lost], pos[lost], row[lost]
    n = count[row]
    place = np.concatenate([[0], np.cumsum(n)])
    inside = np.arange(place[-1]) - np.repeat(place[:-1], n)
    hit = least[np.repeat(begin[row], n) + inside] < np.repeat(doc, n)
    head = np.zeros(len(hit), bool)
    head[place[:-1]] = True
    first = np.flatnonzero(hit & (head | ~np.append(False, hit[:-1])))
    tail = np.append(head[1:], True)
    last = np.flatnonzero(hit & (tail | ~np.append(hit[1:], False)))
    which = np.repeat(np.arange(len(doc)), n)[first]
    runs = (doc[which], pos[which] + inside[first], pos[which] + inside[last] + k)
    told = [(xxhash.xxh3_128_digest(texts[i]), least[begin[i] : begin[i + 1]].tolist()) for i, hi in more if (least[begin[i] : begin[i + 1]] < hi).any()]
    return runs, told


_FOUND = "doc_id long, first long, past long, string binary, least array<long>"


def in_buckets(rows: DataFrame, o: dict) -> DataFrame:
    """Runs to remove (doc_id, first, past), and for strings with unlisted occurrences (string's hash, least doc_id of each window)."""
    spark = rows.sparkSession

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        def said(held):
            (doc, first, past), told = _resolve(held, o)
            n, m = len(doc), len(told)
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(x, pa.int64()), none]) for x in (doc, first, past)]
                + [pa.array([None] * n + [t[0] for t in told], pa.binary()), pa.array([None] * n + [t[1] for t in told], pa.list_(pa.int64()))],
                ["doc_id", "first", "past", "string", "least"],
            )

        held, at = [], None
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != at and held:
                    yield said(held)
                    held = []
                at, data, i = bucket, expand(data), 0
                while i < len(data):
                    n = int.from_bytes(data[i : i + 4], "little")
                    held.append(data[i + 4 : i + 4 + n])
                    i += 4 + n
        if held:
            yield said(held)

    return rows.repartition(parts(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


def unlisted(docs: DataFrame, o: dict) -> DataFrame:
    """string's hash, doc_id, first: every occurrence of the strings that repeat more than ``listed`` times in a block."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for ids, _, pos, _, strings, order, starts in _blocks(batches, o):
            ends = np.append(starts[1:], len(order))
            for a, e in zip(starts.tolist(), ends.tolist()):
                if e - a > o["listed"]:
                    at = order[a:e]
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(strings[at[0]])] * (e - a), pa.binary()), pa.array(ids[at], pa.int64()), pa.array(pos[at], pa.int64())], ["string", "doc_id", "first"])

    return docs.mapInArrow(run, "string binary, doc_id long, first long")


def removed_runs(docs: DataFrame, o: dict) -> DataFrame:
    """doc_id, runs: for each document that loses words, its runs (first << 32 | past the last word), overlapping ones included."""
    judged = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = written(in_buckets(packed(judged, o), o), "buckets")
    collect_garbage(docs.sparkSession)
    span = lambda first, past: (F.shiftleft(first, 32) + past).alias("span")
    runs = found.where("doc_id IS NOT NULL").select("doc_id", span(F.col("first"), F.col("past")))
    told = found.where("string IS NOT NULL").select("string", "least")
    if told.limit(1).count():
        # a string may come from several blocks: all say the same of its windows
        told = told.groupBy("string").agg(F.first("least").alias("least"))
        told = written(told, "strings")
        hot = unlisted(judged, o).join(told, "string")
        window = F.posexplode("least").alias("i", "low")
        hot = hot.select("doc_id", "first", window).where("low < doc_id").select("doc_id", span(F.col("first") + F.col("i"), F.col("first") + F.col("i") + o["window"]))
        runs = runs.union(hot)
    return runs.groupBy("doc_id").agg(F.collect_set("span").alias("runs"))


def kept_words(text: bytes, runs: list[int] | None) -> tuple[int, bytes]:
    """Number of removed words and the kept words, joined by blanks."""
    words = text.split()
    gone = bytearray(len(words))
    for x in runs or ():
        a, b = x >> 32, min(x & 0xFFFFFFFF, len(words))
        gone[a:b] = b"\x01" * max(0, b - a)
    return sum(gone), b" ".join([w for w, g in zip(words, gone) if not g])


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by blanks); options: see DEFAULTS.

    A window's first holder, the least doc_id, keeps it. Null and empty texts have no words. Rows with null
    doc_id neither lose words nor make others lose any. Rows that share a doc_id are one document: none
    removes from another, and what is found in one holds, by word position, for all. Other columns are
    ignored; an empty table gives an empty result.
    """
    o = DEFAULTS | options
    docs = only(docs, doc_id="long", text="string")
    runs = written(removed_runs(docs, o), "runs").withColumnRenamed("doc_id", "run_id")
    collect_garbage(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(b.column(1), b.column(2)):
                raw = (text.as_py() or "").encode()
                g, k = kept_words(raw, spans.as_py())
                n.append(len(raw.split()))
                gone.append(g)
                kept.append(k.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(runs.hint("merge"), docs["doc_id"] == runs["run_id"], "left").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
