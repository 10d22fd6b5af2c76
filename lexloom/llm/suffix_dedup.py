"""Operator 2: exact deduplication of byte strings with suffix arrays built by linear grouping.

Which ``length``-byte strings start more than once in the corpus? Strings are dealt by minimiser (the leftmost
least hash among their ``gram``-byte runs) together with the half string before or after it, whichever the string
holds: a minimiser alone is a few words, which a large corpus always has again. Consecutive strings with one such
key are a stretch of text, and equal strings always have equal keys. Only stretches whose key occurs again travel.
If all stretches of a key are equal as a whole they need no sorting; the others of a bucket are sorted by a suffix
array. A key with more text than a bucket is first divided by longer keys, so no array is larger than a few buckets.

The array is built over anchors, not bytes: from every position the least hash among the next ``step``
grams is its anchor, which equal strings share. An anchor's symbol is the rank of the ``chunk`` bytes from
it on. A chunk reaches past the next anchor, so sequences of symbols compare as the bytes do. Suffix sorting is
by linear grouping: suffixes start in groups by symbol; groups are taken from the greatest down, each suffix
points to the nearest one before it in a smaller group, and those pointed to move, by how often, to new
groups behind their own. Groups then share a Lyndon prefix. Their order follows from one pass that places
each suffix's predecessors, no recursion, no renaming. Neighbours' common bytes divide the array, for every
distance to the anchor, into classes of equal strings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, collect_garbage, mixed, only, parts, table, written
from .substring_dedup import _sliding_min

DEFAULTS = {"length": 400, "gram": 16, "step": 48, "chunk": 64, "bucket_bytes": 2 << 20, "zones": 2, "fine_zones": 16}


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of a sequence of integers by linear grouping (an end below all symbols is added and left out again)."""
    n = len(s) + 1
    if n == 1:
        return []
    buckets: dict[int, list[int]] = {}
    for i, x in enumerate(s):
        buckets.setdefault(x, []).append(i)
    group = [0] * n  # a group is known by the first place of its suffixes in the array
    members: list[list[int] | None] = [None] * n
    size = [0] * n
    members[0], size[0] = [n - 1], 1
    at = 1
    for x in sorted(buckets):
        own = buckets[x]
        for i in own:
            group[i] = at
        members[at], size[at] = own, len(own)
        at += len(own)
    before = [-1] * n  # the nearest suffix to the left in a smaller group
    for g in range(n - 1, -1, -1):
        own = members[g]
        if own is None:
            continue
        own = [i for i in own if group[i] == g]
        own.sort()
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (_, q), moved in sorted(moves.items()) if len(moves) > 1 else moves.items():
            k = len(moved)
            if k == size[q]:
                continue
            size[q] -= k
            new = q + size[q]
            members[new], size[new] = moved, k
            for j in moved:
                group[j] = new
    sa = [-1] * n
    free = list(range(n))  # by group: its next free place
    sa[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = sa[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            sa[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return sa[1:]


def _gram_hashes(raw, gram: int):
    """A hash of the gram bytes (8 or 16) from each position on."""
    import numpy as np

    x = raw.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    return mixed(x) if gram == 8 else mixed(x[:-8] * np.uint64(0x9E3779B97F4A7C15) + mixed(x[8:]))


def _keyed(texts: list[bytes], o: dict, zones: int):
    """key, text's place, first string, number of strings, again of the stretches of texts (length bytes at least in all).

    A string's zone says how far on its minimiser is; the key hashes the bytes that all strings of a minimiser and zone share.
    again: the stretch has several minimisers, so its strings may repeat within it.
    """
    import numpy as np

    length, gram = o["length"], o["gram"]
    width = length - gram + 1
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h = _gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram)
    # the leftmost least gram of every string, hash and place in one number
    least = _sliding_min(h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), width)
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(len(place), bool)
    for e in off[1:].tolist():
        valid[max(0, e - length + 1) : e] = False
    zone = (place - np.arange(len(place))) * zones // width
    turn = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (zone[1:] != zone[:-1])))
    key = np.zeros(len(turn), np.uint64)
    for z in range(zones):
        own = np.flatnonzero(zone[turn] == z)
        nearest, end = -(-z * width // zones), length - gram + 1 + (-(z + 1) * width // zones)
        x = np.full(len(own), z + 1, np.uint64)
        for r in [*range(-nearest, end, gram), end]:
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[np.clip(place[turn[own]] + r, 0, len(h) - 1)]
        key[own] = mixed(x)
    key = np.repeat(key, np.diff(np.append(turn, len(place))))
    same = np.zeros(len(valid), bool)
    same[1:] = valid[1:] & valid[:-1] & (key[1:] == key[:-1])
    first = np.flatnonzero(valid & ~same)
    last = np.flatnonzero(valid & ~np.append(same[1:], False))
    doc = np.searchsorted(off, first, side="right") - 1
    return key[first].view(np.int64), doc, first - off[doc], last - first + 1, place[first] != place[last]


def stretches(docs: DataFrame, o: dict) -> DataFrame:
    """key, doc_id, first, n, again: stretches of n strings from byte first on with one key; again: strings may repeat within the stretch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, texts in chunks(b.column(1)):
                if sum(map(len, texts)) < o["length"]:
                    continue
                key, doc, first, n, again = _keyed(texts, o, o["zones"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.asarray(ids[at : at + len(texts)], np.int64)[doc]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again, pa.bool_())],
                    ["key", "doc_id", "first", "n", "again"],
                )

    return docs.mapInArrow(run, "key long, doc_id long, first int, n int, again boolean")


def _sent(texts: DataFrame, o: dict) -> DataFrame:
    """key, data of the stretches to compare. What repeats within a batch is removed there and then and travels once.

    data: 0, doc_id, first, past (bytes to remove); or 1, doc_id, first, text of a stretch; or 2, text (it occurs more than once).
    """
    length = o["length"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            seen: dict[bytes, list] = {}
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = text.as_py().encode()
                for x in spans.as_py():
                    first, n = x["first"], x["n"]
                    seen.setdefault(raw[first : first + n - 1 + length], [x["key"]]).append((doc_id, first))
            keys, data = [], []
            for s, (key, *places) in seen.items():
                keys.append(key)
                if len(places) == 1:
                    data.append(struct.pack("<BqI", 1, *places[0]) + s)
                else:
                    data.append(b"\x02" + s)
                    for doc_id, first in places:
                        keys.append(doc_id)
                        data.append(struct.pack("<BqII", 0, doc_id, first, first + len(s)))
            for a in range(0, len(keys), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 20_000], pa.int64()), pa.array(data[a : a + 20_000], pa.binary())], ["key", "data"])

    return texts.mapInArrow(run, "key long, data binary")


def repeated_places(strings: list[bytes], weights: list[int], o: dict) -> list:
    """For each distinct string, which of its length-byte windows occur more than once (a string of weight 2 counts twice)."""
    import numpy as np

    length, step, chunk = o["length"], o["step"], o["chunk"]
    pad = length + chunk
    begin = np.concatenate([[0], np.cumsum([len(s) + pad for s in strings])]).astype(np.int64)
    raw = np.zeros(int(begin[-1]), np.uint8)
    for s, a in zip(strings, begin.tolist()):
        raw[a : a + len(s)] = np.frombuffer(s, np.uint8)
    count = np.array([len(s) - length + 1 for s in strings], np.int64)
    place = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(place[-1]) - np.repeat(place[:-1], count)
    window = np.repeat(begin[:-1], count) + inside
    # the anchor of every position: the leftmost least gram hash among the next step, hash and place in one number
    h = _gram_hashes(raw, 8) >> np.uint64(32) << np.uint64(32)
    local = np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    least = _sliding_min(h | local, step)
    anchor_of = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    real = np.zeros(len(raw), bool)
    for s, a in zip(strings, begin.tolist()):
        real[a : a + max(0, len(s) - step - 8 + 1)] = True  # positions whose anchor is found within the string
    anchors = np.unique(anchor_of[np.flatnonzero(real[: len(anchor_of)])])
    rows = raw[anchors[:, None] + np.arange(chunk)]
    _, symbol = np.unique(np.ascontiguousarray(rows).view(f"S{chunk}").ravel(), return_inverse=True)
    owner = np.searchsorted(begin, anchors, side="right") - 1
    ends = np.flatnonzero(np.diff(owner)) + 1
    sequence = np.insert(symbol.ravel() + 1, ends, 0)  # 0 parts the strings
    is_anchor = np.insert(np.ones(len(anchors), bool), ends, False)
    number = np.cumsum(is_anchor) - 1
    sa = np.array(suffix_array(sequence.tolist()), np.int64)
    sa = number[sa[is_anchor[sa]]]  # anchors in the order of their suffixes
    rank = np.empty(len(sa), np.int64)
    rank[sa] = np.arange(len(sa))
    # common bytes of neighbours, up to length, eight at a time
    common = np.full(len(sa), 0, np.int64)
    a, b, live = anchors[sa[:-1]], anchors[sa[1:]], np.arange(1, len(sa))
    eight = np.arange(8)
    for k in range(0, length, 8):
        if not len(live):
            break
        x, y = raw[(a + k)[:, None] + eight], raw[(b + k)[:, None] + eight]
        differ = x != y
        some = differ.any(1)
        common[live[some]] = k + differ[some].argmax(1)
        common[live[~some]] = k + 8
        a, b, live = a[~some], b[~some], live[~some]
    # hashes of the bytes between a window's start and its anchor
    anchor = anchor_of[window]
    distance = anchor - window
    rng = np.random.default_rng(2)
    halves = []
    classes = np.empty(len(window), np.uint64)
    order = np.argsort(distance, kind="stable")
    cuts = np.searchsorted(distance[order], np.arange(step + 1))
    where = np.searchsorted(anchors, anchor)
    for t in range(step):
        at = order[cuts[t] : cuts[t + 1]]
        if len(at):
            classes[at] = np.cumsum(common < length - t)[rank[where[at]]].astype(np.uint64)
    for _ in range(2):
        value = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 4 + 1
        power = np.cumprod(np.full(len(raw) + 1, base, np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
        inverse = np.cumprod(np.full(len(raw) + 1, pow(base, -1, 1 << 64), np.uint64)) * np.uint64(base)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value[raw] * power[: len(raw)], out=total[1:])
        before = (total[anchor] - total[window]) * inverse[window]
        halves.append(mixed(before + mixed(classes * np.uint64(step) + distance.astype(np.uint64))))
    order = np.lexsort((halves[1], halves[0]))
    x, y = halves[0][order], halves[1][order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    weight = np.repeat(np.array(weights, np.int64), count)
    many = np.add.reduceat(weight[order], np.flatnonzero(new)) > 1
    hit = np.empty(len(order), bool)
    hit[order] = many[np.cumsum(new) - 1]
    return [hit[i:j] for i, j in zip(place[:-1].tolist(), place[1:].tolist())]


def _finer(texts: dict[bytes, list], o: dict) -> list[dict[bytes, list]]:
    """The stretches of one key divided by keys of more bytes, without those that stand alone; texts: weight and places (doc_id, first) by string."""
    finer: dict[int, dict[bytes, list]] = {}
    strings, repeats = list(texts), set()
    at = size = 0  # in pieces, as many integers a byte are held
    for i, s in enumerate(strings):
        size += len(s)
        if size < o["bucket_bytes"] and i + 1 < len(strings):
            continue
        for key, j, first, n, again in zip(*(x.tolist() for x in _keyed(strings[at : i + 1], o, o["fine_zones"]))):
            if again:
                repeats.add(key)
            weight, *places = texts[strings[at + j]]
            t = finer.setdefault(key, {}).setdefault(strings[at + j][first : first + n - 1 + o["length"]], [0])
            t[0] += weight
            t += [(doc_id, a + first) for doc_id, a in places]
        at, size = i + 1, 0
    return [t for key, t in finer.items() if len(t) > 1 or key in repeats or next(iter(t.values()))[0] > 1]


def _resolve(groups: list[list[bytes]], o: dict) -> Iterator[list[tuple[int, int, int]]]:
    """Bytes to remove (doc_id, first, past) from the rows of complete keys, a list of rows each."""
    import numpy as np

    length = o["length"]
    out, sort, size = [], {}, 0

    def sorted_out():
        strings = list(sort)
        for s, hit in zip(strings, repeated_places(strings, [min(2, sort[s][0]) for s in strings], o)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
            for doc_id, first in sort[s][1:]:
                out.extend((doc_id, first + a, first + e - 1 + length) for a, e in zip(edge[::2], edge[1::2]))

    for rows in groups:
        texts: dict[bytes, list] = {}
        for x in rows:
            if x[0] == 0:
                out.append(struct.unpack_from("<qII", x, 1))
            elif x[0] == 1:
                doc_id, first = struct.unpack_from("<qI", x, 1)
                t = texts.setdefault(x[13:], [0])
                t[0] += 1
                t.append((doc_id, first))
            else:
                texts.setdefault(x[1:], [0])[0] += 2
        for same in _finer(texts, o) if sum(map(len, texts)) > o["bucket_bytes"] else [texts]:
            if len(same) == 1 and (s := next(iter(same))) and same[s][0] > 1:
                out += [(doc_id, first, first + len(s)) for doc_id, first in same[s][1:]]
                continue
            sort |= same
            size += sum(map(len, same))
            if size > o["bucket_bytes"]:
                sorted_out()
                yield out
                out, sort, size = [], {}, 0
    if sort:
        sorted_out()
    yield out


def _in_buckets(rows: DataFrame, o: dict) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def said(held):
            for found in _resolve(held, o):
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "first", "past"])

        held, size, at = [], 0, None  # the rows of each key
        for b in batches:
            keys, data = b.column(0).to_numpy(), b.column(1).to_pylist()
            cuts = (np.flatnonzero(np.diff(keys)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if hi <= lo:
                    continue
                if not held or keys[lo] != at:
                    if size > o["bucket_bytes"]:
                        yield from said(held)
                        held, size = [], 0
                    held.append([])
                at = keys[lo]
                held[-1] += data[lo:hi]
                size += sum(map(len, data[lo:hi]))
        if held:
            yield from said(held)

    return rows.repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, first long, past long")


def removed_runs(docs: DataFrame, o: dict) -> DataFrame:
    """doc_id, runs (first << 32 | past) for each document that loses bytes; overlapping runs included."""
    judged = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = written(stretches(judged, o), "stretches")
    shared = found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    # a stretch that stands alone can still repeat within itself, where its minimiser does
    travel = found.join(shared.hint("merge"), "key").union(found.where("again"))
    spans = travel.groupBy("doc_id").agg(F.collect_set(F.struct("first", "n", "key")).alias("spans")).withColumnRenamed("doc_id", "span_id")
    spans = written(spans, "spans")
    texts = judged.join(spans.hint("merge"), judged["doc_id"] == spans["span_id"]).select("doc_id", "text", "spans")
    runs = _in_buckets(_sent(texts, o), o)
    return runs.groupBy("doc_id").agg(F.collect_set(F.shiftleft("first", 32) + F.col("past")).alias("runs"))


def merged(runs: list[int] | None, n: int) -> list[tuple[int, int]]:
    """Maximal removed runs within n bytes."""
    out: list[list[int]] = []
    for x in sorted(runs or ()):
        a, b = x >> 32, min(x & 0xFFFFFFFF, n)
        if b <= a:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes); options: see DEFAULTS.

    Every copy of a repeated string goes, the first included. A null text is empty. Rows with null doc_id
    neither lose bytes nor count as copies. Rows that share a doc_id are compared like any others, and what
    is found in one holds, by byte position, for all. Other columns are ignored; an empty table gives an
    empty result.
    """
    o = DEFAULTS | options
    docs = only(docs, doc_id="long", text="string")
    runs = written(removed_runs(docs, o), "runs").withColumnRenamed("doc_id", "run_id")
    collect_garbage(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols = [[], [], [], []]
            for text, spans in zip(b.column(1), b.column(2)):
                raw = (text.as_py() or "").encode()
                gone = merged(spans.as_py(), len(raw))
                kept, at = [], 0
                for x, y in gone:
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                for c, v in zip(cols, (len(raw), sum(y - x for x, y in gone), len(gone), b"".join(kept))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.join(runs.hint("merge"), docs["doc_id"] == runs["run_id"], "left").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
