"""Operator 5: benchmark decontamination by SimHash of item-sized windows, multi-index lookup and exact verification.

Words are lower-cased and lose ASCII punctuation. A text region can only be similar to an item if it shares a
shingle with some item, so windows are laid where it does, at every start from which an item-sized window
can hold the shared shingles. Each window gets a 256-bit SimHash of its shingle multiset. The items'
fingerprints are indexed by many short blocks of bits: a differing bit spoils one block, so two fingerprints
within the radius agree in at least ``blocks - radius`` of them, and the lookup returns every item that does.
The radius lies five standard deviations beyond the expected distance of a pair at the threshold; unlike items
agree in so many blocks by negligible chance. What is returned is verified exactly by the weighted Jaccard
similarity of the shingle multisets (sum of least over sum of largest counts).

The items are a stated query set. They travel to the executors in blocks of about ``block_words`` words, each a
narrow pass over the documents: no shuffle of texts, whatever the benchmark's size. With several blocks each
pass's matches are written before the next block is collected, so one block at a time is held anywhere.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mixed, only, table, window_hashes, written

PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
SHINGLE, THRESHOLD, BITS, BLOCK_BITS = 5, 0.8, 256, 2
#: The items that this Python worker indexed last, by the name that the driver gave them.
_built: dict[str, Items] = {}


def normalised(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(None, PUNCTUATION)


def radius_for(threshold: float, deviations: float = 5.0) -> int:
    """A Hamming radius that pairs of this weighted Jaccard similarity exceed with negligible chance: their cosine is 2t/(1+t)."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return min(BITS - 1, math.ceil(BITS * p + deviations * math.sqrt(BITS * p * (1 - p))))


def _signs(hashes):
    """BITS signs of each shingle: its 64-bit hash mixed once for each 64 of them."""
    import numpy as np

    lanes = np.stack([mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(lanes.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int8) * 2 - 1


class MultiIndex:
    """Finds every stored fingerprint (a row of BITS zeros and ones) within ``radius`` bits of a query."""

    def __init__(self, fingerprints, radius: int):
        import numpy as np

        self.fp, self.radius = fingerprints.reshape(-1, BITS), radius
        self.at = np.arange(BITS // BLOCK_BITS)
        self.least = len(self.at) - radius
        keys = self._keys(self.fp)
        self.tables = np.stack([(keys == v).T for v in range(1 << BLOCK_BITS)], axis=1).astype(np.uint8)  # block, value, item

    def _keys(self, fp):
        import numpy as np

        return fp.reshape(len(fp), len(self.at), BLOCK_BITS) @ (1 << np.arange(BLOCK_BITS))

    def candidates(self, query):
        """Places of the stored fingerprints that agree with the query in as many blocks as any within the radius must."""
        import numpy as np

        agree = self.tables[self.at, self._keys(query[None])[0]].sum(0, dtype=np.int16)
        return np.flatnonzero(agree >= self.least)

    def near(self, query):
        at = self.candidates(query)
        return at[(self.fp[at] != query).sum(1) <= self.radius]


class Items:
    """A block of benchmark items, ready for windows to be looked up."""

    def __init__(self, rows: list[tuple[int, bytes]], threshold: float, shingle: int):
        import numpy as np
        import xxhash

        self.threshold, self.k = threshold, shingle
        self.ids, self.bags, self.words, prints = [], [], [], []
        self.short: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        places = defaultdict(set)
        for item_id, raw in rows:
            words = raw.split()
            h = window_hashes(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), shingle)
            if not len(h):
                if words:
                    self.short[tuple(words)].append(item_id)
                continue
            for o, x in enumerate(h.tolist()):
                places[x].add((len(words), o))
            self.ids.append(item_id)
            self.words.append(len(words))
            self.bags.append(Counter(h.tolist()))
            prints.append(_signs(h).sum(0, dtype=np.int32) > 0)
        self.places = dict(places)
        self.shared = np.array(sorted(places), np.uint64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.shared & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.index = MultiIndex(np.array(prints, np.uint8), radius_for(threshold))

    def seeds(self, shingles):
        """Positions whose shingle some item has."""
        import numpy as np

        at = np.flatnonzero(self.filter[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.shared, shingles[at]), len(self.shared) - 1)
        return at[self.shared[place] == shingles[at]]

    def matches(self, shingles, seeds) -> dict[int, tuple[float, int, int]]:
        """item's place: (similarity, first word, words) of its best window in a text with these shingles."""
        import numpy as np

        best: dict[int, tuple[float, int, int]] = {}
        last = len(shingles)
        windows = set()
        by_size: dict[int, set[int]] = defaultdict(set)
        for p in seeds.tolist():
            for size, offset in self.places[int(shingles[p])]:
                by_size[size].add(p - offset)
        for size, starts in by_size.items():
            m = size - self.k + 1
            ordered = sorted(starts)
            for a, b in zip(ordered, ordered[1:]):
                if b - a < m:  # pieces out of step: every window between them too
                    starts.update(range(a, b))
            windows |= {(min(max(0, s), max(0, last - m)), m) for s in starts}
        ordered = sorted(windows)
        at = 0
        while at < len(ordered):
            lo = ordered[at][0]
            part = [x for x in ordered[at : at + 1024] if x[0] < lo + 8192]  # windows of a stretch, however long the text
            at += len(part)
            hi = min(last, max(s + m for s, m in part))
            sums = np.zeros((hi - lo + 1, BITS), np.int32)
            np.cumsum(_signs(shingles[lo:hi]), axis=0, out=sums[1:])
            for s, m in part:
                query = (sums[min(s + m, hi) - lo] > sums[s - lo]).astype(np.uint8)
                near = self.index.near(query)
                if not len(near):
                    continue
                bag = Counter(shingles[s : s + m].tolist())
                total = sum(bag.values())
                for i in near.tolist():
                    both = sum(min(n, bag[x]) for x, n in self.bags[i].items() if x in bag)
                    similarity = both / (total + sum(self.bags[i].values()) - both)
                    if similarity >= self.threshold and similarity > best.get(i, (0.0,))[0]:
                        best[i] = (similarity, s, min(m, last - s) + self.k - 1)
        return best


def indexed(name: str, held: Broadcast, threshold: float, shingle: int) -> Items:
    """The broadcast items, indexed once by each Python worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(held.value, threshold, shingle)
    return _built[name]


def matches(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, shingle: int = SHINGLE, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each document's best window for every item that it holds.

    An item of fewer words than a shingle is one shingle, as is a text of so few words: such an item is found where
    it is the whole text. Items and texts without words match nothing; null texts hold nothing; null
    doc_ids and item_ids are carried as they are; repeated rows give repeated results; items with equal text
    are found each; other columns are ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    docs = only(docs, doc_id="long", text="string")
    items = only(benchmark, item_id="long", text="string").where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_words))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for k in range(blocks):
        rows = [(r.item_id, normalised(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        held = spark.sparkContext.broadcast(rows)  # about block_words words

        def run(batches: Iterator, held=held, name=uuid.uuid4().hex) -> Iterator:
            import numpy as np
            import pyarrow as pa

            from .common import word_hashes

            index = indexed(name, held, threshold, shingle)
            names = [x.split()[0] for x in schema.split(", ")]
            if not index.ids and not index.short:
                return
            for b in batches:
                out = []
                texts, at, size = [], 0, 0
                for i in range(b.num_rows):
                    texts.append(normalised(b.column(1)[i].as_py()))
                    size += len(texts[-1])
                    if size < 1 << 20 and i < b.num_rows - 1:
                        continue
                    for d, t in enumerate(texts if index.short else ()):
                        words = tuple(t.split(None, shingle))
                        for item_id in index.short.get(words, ()):
                            out.append((b.column(0)[at + d].as_py(), item_id, 1.0, 0, len(words)))
                    h, off = word_hashes(texts)
                    w = window_hashes(h, shingle)
                    seeds = index.seeds(w)
                    doc = np.searchsorted(off, seeds, side="right") - 1
                    for d in np.unique(doc).tolist():
                        a, e = int(off[d]), int(off[d + 1]) - shingle + 1
                        own = seeds[(doc == d)]
                        own = own[own < e] - a  # not those that run into the next text
                        if len(own):
                            for j, (s, first, n) in sorted(index.matches(w[a:e], own).items()):
                                out.append((b.column(0)[at + d].as_py(), index.ids[j], s, first, n))
                    texts, at, size = [], i + 1, 0
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names)

        part = docs.mapInArrow(run, schema)
        if blocks > 1:
            part = written(part, "leaks")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The table's rows without the documents that hold a benchmark item. Rows with null doc_id stay."""
    hit = matches(docs, benchmark, **options).select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    return docs.join(hit, docs["doc_id"].cast("long") == hit["_id"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
