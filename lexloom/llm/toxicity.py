"""Operator 4: toxicity by maximum-scoring segments over token log-odds.

Training counts the tokens of labelled documents by class: words and their beginnings of ``stems`` characters,
which inflected forms share. A token's weight is its log-odds between the classes under an informative
Dirichlet prior (``prior`` times its counts of both classes together); tokens whose z-score is below
``min_z`` carry no evidence. A word weighs what its best token weighs; a word without evidence costs
``drift``, so that a text without evidence drifts down.
One linear scan finds all maximal segments of a text (Ruzzo and Tompa). Their scores follow an extreme-value
law in clean text: lambda solves sum p(s) exp(lambda s) = 1 over the clean word distribution, K is the
maximum-likelihood rate of the best scores of clean training documents. A text's evidence is that of its
significant segments, each worth lambda S - ln(K n); a logistic curve over it, fitted on binned counts of all
training documents, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, only, table, written
from .decontaminate import PUNCTUATION

DEFAULTS = {"min_z": 3.5, "prior": 0.1, "drift": 0.05, "stems": (4, 5, 6, 7), "block_terms": 100_000, "folds": 5, "bin": 0.25, "bins": 400}
#: Tokens counted by a task before they are handed on, and words whose weight a task remembers.
HELD = 300_000


def _words(raw: bytes) -> list[str]:
    return raw.decode().lower().encode().translate(None, PUNCTUATION).decode().split()


def _tokens(word: str, stems: tuple[int, ...]) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in stems if len(word) > n]]


def labelled(docs: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """doc_id, text, toxic of the training rows: labelled ones whose crc32(doc_id as text) mod folds is not 0. Of several labels of an id the highest counts."""
    marks = only(labels, doc_id="long", toxic="int").dropna().where(F.crc32(F.col("doc_id").cast("string")) % folds != 0).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return docs.join(marks.hint("merge"), "doc_id")  # texts are dealt alike however many labels there are


def token_counts(train: DataFrame, stems: tuple[int, ...]) -> DataFrame:
    """token, toxic, clean: in how many training documents of either class the token stands. Counted in each task before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def said(count):
            tokens = list(count[0] | count[1])
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([count[1][w] for w in tokens], pa.int64()), pa.array([count[0][w] for w in tokens], pa.int64())], ["token", "toxic", "clean"])

        count = (Counter(), Counter())
        for b in batches:
            marks = b.column(1).to_pylist()
            for at, texts in chunks(b.column(0)):
                for i, t in enumerate(texts):
                    count[marks[at + i]].update({x for w in set(_words(t)) for x in _tokens(w, stems)})
                if len(count[0]) + len(count[1]) > HELD:
                    yield said(count)
                    count = (Counter(), Counter())
        yield said(count)

    return train.select("text", "toxic").mapInArrow(run, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def weights(counts: DataFrame, o: dict) -> tuple[DataFrame, list[tuple[float, float]], float]:
    """(token, delta) of every token with evidence, (share of the clean tokens, weight) of them in narrow bins of weight, share of the rest."""
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = float(total.t or 0), float(total.c or 0)
    if not t or not c:
        return counts.select("token", F.lit(0.0).alias("delta")).limit(0), [], 1.0
    a = (F.col("toxic") + F.col("clean")) * o["prior"]
    every = (t + c) * o["prior"]
    odds = lambda y, n: F.log((y + a) / (n + every - y - a))
    delta = odds(F.col("toxic"), t) - odds(F.col("clean"), c)
    z = delta / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    found = counts.select("token", "clean", delta.alias("delta"), z.alias("z")).where((F.col("z") >= o["min_z"]) & (F.col("delta") > 0))
    share = (F.col("clean") + 0.5) / c
    bins = found.groupBy(F.round("delta", 3).alias("bin")).agg(F.sum(share).alias("p"), F.sum(share * F.col("delta")).alias("ps")).orderBy("bin").collect()  # log-odds in thousandths: some ten thousand at most
    mass = [(r.p, r.ps / r.p) for r in bins]
    return found.select("token", "delta"), mass, max(1e-9, 1 - sum(p for p, _ in mass))


def decay(mass: list[tuple[float, float]], rest: float, drift: float) -> float:
    """The positive root lambda of sum p exp(lambda s) = 1."""
    f = lambda x: sum(p * math.exp(min(x * s, 700)) for p, s in mass) + rest * math.exp(-x * drift) - 1
    if not mass or sum(p * s for p, s in mass) - rest * drift >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in linear time.

    scores: positions and weights of the words that carry evidence; each word between costs drift. Segments
    are kept as candidates with the cumulative totals at their left and right ends; a new one looks back for
    the nearest with a lower left end and swallows it when its own right end is higher.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, left total, right total, index of the nearest with lower left
    total, at = 0.0, -1
    for pos, s in scores:
        total -= drift * (pos - at - 1)
        first, left, at = pos, total, pos
        total += s
        back = len(kept) - 1
        while True:
            while back >= 0 and kept[back][2] >= left:
                back = kept[back][4]
            if back < 0 or kept[back][3] >= total:
                kept.append((first, pos, left, total, back))
                break
            first, left = kept[back][0], kept[back][2]
            del kept[back:]
            back -= 1
    return [(f, e, r - l) for f, e, l, r, _ in kept]


def segments(docs: DataFrame, terms: DataFrame, o: dict) -> DataFrame:
    """doc_id, n_words, passages (first word, last word, score): the maximal segments of each text.

    Terms travel to the executors in hash blocks of about ``block_terms``, each a narrow pass over the texts that
    keeps a word's best weight so far; passes but the last are written, so that one block at a time is held anywhere.
    """
    spark = docs.sparkSession
    blocks = max(1, math.ceil(terms.count() / o["block_terms"]))
    for k in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast({r.token: r.delta for r in part.collect()})  # about block_terms words
        docs = _weighed(docs, held, o, k, k == blocks - 1)
        if k < blocks - 1:
            docs = written(docs, "weighed")
            held.destroy()
    return docs


def _weighed(docs: DataFrame, held: Broadcast, o: dict, k: int, last: bool) -> DataFrame:
    """One pass: the held terms' weights, with those of the k passes before; the last pass gives the segments."""
    drift, stems = o["drift"], o["stems"]
    weight = "array<struct<at:long,weight:double>>"
    passages = "array<struct<first:long,last:long,score:double>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        get, known = held.value.get, {}

        def weigh(word):
            if word in known:
                return known[word]
            best = max((x for x in map(get, _tokens(word, stems)) if x is not None), default=None)
            if len(known) > HELD:
                known.clear()
            known[word] = best
            return best

        hit = pa.list_(pa.struct([("at", pa.int64()), ("weight", pa.float64())]))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            n, found = [], []
            for at, texts in chunks(b.column(1)):
                for i, t in enumerate(texts):
                    words = _words(t)
                    n.append(len(words))
                    hits = [(j, x) for j, x in enumerate(map(weigh, words)) if x is not None]
                    if k:
                        best = {x["at"]: x["weight"] for x in b.column(2)[at + i].as_py()}
                        for j, x in hits:
                            best[j] = max(x, best.get(j, x))
                        hits = sorted(best.items())
                    if last:
                        found.append([{"first": f, "last": e, "score": s} for f, e, s in maximal_segments(hits, drift)] if hits else [])
                    else:
                        found.append([{"at": j, "weight": x} for j, x in hits])
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "passages"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, hit)], ["doc_id", "text", "hits"])

    return docs.mapInArrow(run, f"doc_id long, n_words long, passages {passages}" if last else f"doc_id long, text string, hits {weight}")


def _logistic(bins: list[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float]:
    """a, b of P(toxic) = 1 / (1 + exp(-(a + b x))) from (x, toxic, clean) counts, by Newton steps with a weak ridge."""
    a, b = 0.0, 0.1
    for _ in range(rounds):
        g = [-1e-3 * a, -1e-3 * b]
        h = [[1e-3, 0.0], [0.0, 1e-3]]
        for x, t, c in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            n = t + c
            r, w = t - n * p, n * p * (1 - p)
            g[0] += r
            g[1] += r * x
            h[0][0] += w
            h[0][1] += w * x
            h[1][1] += w * x * x
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        da, db = (h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[0][1] * g[0]) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(b, 1e-3)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (the significant ones); options: see DEFAULTS.

    A null or empty text has no segments and gets the score of no evidence. Rows with null doc_id are scored
    and not held out. Repeated rows give repeated results. Without training rows of both classes every score
    is the share of toxic training rows (0 without any). Other columns are ignored.
    """
    o = DEFAULTS | options
    docs = only(docs, doc_id="long", text="string")
    train = labelled(docs, labels, o["folds"])
    counts = written(token_counts(train, o["stems"]), "token-counts")
    terms, mass, rest = weights(counts, o)
    found = written(segments(docs, terms, o), "segments")
    lam = decay(mass, rest, o["drift"])
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p.getField("score"))), F.lit(0.0))
    n = F.greatest(F.col("n_words"), F.lit(1))
    marks = labelled(found.select("doc_id", "n_words", "passages"), labels, o["folds"])
    clean = marks.where("toxic = 0").agg(F.count("*").alias("n"), F.sum(n * F.exp(-lam * best)).alias("s")).first()
    k = clean.n / clean.s if clean.n and clean.s else 1.0
    # a segment counts from where it is no longer expected in clean text of this length
    worth = F.aggregate(F.transform("passages", lambda p: F.greatest(lam * p.getField("score") - F.log(k * n), F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)
    top = lam * best - F.log(k * n)
    evidence = F.when(worth > 0, F.least(worth, F.lit(o["bin"] * o["bins"]))).otherwise(F.greatest(top, F.lit(-10.0)))
    evidence = F.when(F.size("passages") > 0, evidence).otherwise(F.lit(-10.0))
    rows = marks.select(F.floor(evidence / o["bin"]).alias("x"), "toxic").groupBy("x").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()  # as many rows as bins
    bins = [((r.x + 0.5) * o["bin"], r.t, r.n - r.t) for r in sorted(rows, key=lambda r: r.x)]
    t, every = sum(x[1] for x in bins), sum(x[1] + x[2] for x in bins)
    if t and t < every:
        a, b = _logistic(bins)
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * evidence)))
    else:
        p = F.lit(float(t > 0))
    passages = F.filter("passages", lambda x: lam * x.getField("score") > F.log(k * n))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % o["folds"] == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), p.cast("double").alias("score"), (p >= 0.5).cast("int").alias("predicted"), passages.alias("passages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("n_passages", F.size("passages")).drop("passages")
