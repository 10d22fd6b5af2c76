import itertools
import math
import random
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as fn
from lexloom.operators import annotate, deptree, evaluate, features, flags, labels, mentions, mining, quality, rank, segment, supervise, tuples, vocab


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(0, "new york city is big", "NNP NNP NN VBZ JJ"), (1, "i love new york", "PRP VBP NNP NNP"), (2, "new york city", "NNP NNP NN")]
    return spark.createDataFrame([(i, t.split(), t.split(), g.split()) for i, t, g in rows], "sent_id long, surfaces array<string>, tokens array<string>, tags array<string>")


def test_mining(toy):
    got = {r.gram: r.freq for r in mining.frequent_grams(toy, 2, 3).collect()}
    assert got == {"new": 3, "york": 3, "city": 2, "new york": 3, "york city": 2, "new york city": 2}
    assert not mining.all_grams(toy, 3).where("gram = 'big i'").count()


def test_completeness_and_idf(toy):
    p = mining.frequent_grams(toy, 2, 3)
    c = {r.gram: r for r in features.completeness(p).collect()}
    assert c["new york city"].complete_sub == pytest.approx(2 / 3) and c["york city"].complete_sub == pytest.approx(2 / 3)
    assert c["new york"].complete_super == pytest.approx(2 / 3) and c["new york"].complete_sub == 1
    i = {r.token: r.idf for r in vocab.idf(annotate.tokens(toy)).collect()}
    assert i["city"] == pytest.approx(math.log(1.5 + 1e-8)) and i["new"] == pytest.approx(math.log(1 + 1e-8))


def test_split_statistics(toy):
    p = features.with_probability(mining.frequent_grams(toy, 2, 3), annotate.tokens(toy))
    r = {x.gram: x for x in features.best_split(p).collect()}
    pr = {x.gram: x.prob for x in p.collect()}
    assert r["new york"].f1 == pytest.approx(pr["new york"] / pr["new"] / pr["york"])
    assert r["new york city"].f2 == pytest.approx(2 / math.sqrt(3) / math.sqrt(2), rel=1e-6)


def test_first_tags_and_external(toy, spark):
    p = mining.frequent_grams(toy, 2, 2)
    assert {r.gram: r.tags for r in mining.first_tags(toy, p, 2).collect()}["new york"] == "NNP NNP"
    more = mining.with_external(p, spark.createDataFrame([("big apple",), ("new york",), ("a b c d",)], "gram string"), 2, 3)
    assert {r.gram: r.freq for r in more.collect()}["big apple"] == 2 and more.count() == p.count() + 1


def test_prune(toy):
    got = {r.gram for r in mining.unpruned_grams(toy, ("PRP",), ("VBP", "PRP"), 2).select("gram").collect()}
    assert "i" not in got and "i love" not in got and "love new" in got


def test_case_codes(spark):
    df = spark.createDataFrame([("USA",), ("Apple",), ("42",), ("ibm",), (",",), ("",)], "w string")
    assert [r.c for r in df.select(fn.case_code(F.col("w")).alias("c")).collect()] == [3, 1, 4, 0, 3, 3]
    assert [r.c for r in df.select(fn.case_bits(F.col("w")).alias("c")).collect()] == [3, 1, 4, 0, 3, 3]


def test_flags(spark):
    words = '( foo ) - bar , " baz "'.split()
    s = spark.createDataFrame([(0, words, words, ["NN"] * len(words))], "sent_id long, surfaces array<string>, tokens array<string>, tags array<string>")
    r = {x.pos: x for x in flags.token_flags(annotate.tokens(s)).collect()}
    assert r[1].paren_before and r[1].paren_after and r[1].separator_after and not r[1].dash_after
    assert not r[4].quote_before and r[7].quote_before and r[7].quote_after and r[2].dash_after


def test_vocab_and_coding(toy):
    t = annotate.tokens(toy)
    v = vocab.first_seen_ids(t)
    assert [r.token for r in v.orderBy("token_id").collect()] == ["new", "york", "city", "is", "big", "i", "love"]
    e = vocab.encoded(t, v.where("token <> 'love'"))
    assert {r.sent_id: r.ids for r in e.collect()}[1] == [6, -1, 1, 2]
    assert {r.sent_id: r.tokens for r in vocab.decoded(e, v).collect()}[1] == ["i", None, "new", "york"]


def test_labels(spark):
    p = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 0), ("d", 2, 1)], "gram string, n int, freq long")
    e, r = p.where("gram IN ('a', 'c')"), p.where("gram IN ('a', 'b')")
    got = labels.distant_labels(p, e, r)
    assert {x.gram: x.label for x in got.collect()} == {"a": 1, "b": 2, "c": 1, "d": 0}
    assert {x.gram: x.label for x in labels.without_wrong(got).collect()}["c"] is None
    assert labels.capped(p, 2, F.col("gram")).count() == 2 and labels.capped(p, -1, F.col("gram")).count() == 4
    assert {x.gram: x.label for x in labels.with_expert(got, spark.createDataFrame([(2, "d")], "label int, gram string")).collect()}["d"] == 2


def test_ranked_lists(spark):
    rows = [(f"g{i}", 1 + i % 2, 1, (i * 7 % 10) / 10, ("EP", "RP", "BP")[i % 3]) for i in range(60)]
    got = quality.ranked(spark.createDataFrame(rows, "gram string, n int, freq long, quality double, indicator string")).collect()
    for b in {r.bucket for r in got}:
        own = sorted((r for r in got if r.bucket == b), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert [(r.quality, r.gram) for r in own] == sorted(((r.quality, r.gram) for r in own), reverse=True)


def test_forest_needs_two_classes(spark):
    with pytest.raises(ValueError, match="two classes"):
        quality.balanced(spark.createDataFrame([("a", 1)], "gram string, label int"))


def test_shape():
    assert deptree.shape([2, 0, 2]) == "(x(x(x)(x)))"
    assert deptree.shape([2, 2], [2, 3]) == "(x(x)(x))"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9))
def test_shape_totals_agree(heads):
    n = len(heads)
    heads = [min(h, i) for i, h in enumerate(heads)]  # heads before their words: acyclic
    for s, e in itertools.combinations(range(n + 1), 2):
        local = [h - s if s < h <= e else 0 for h in heads[s:e]]
        assert deptree.shape(heads[s:e], list(range(s, e))) == deptree.shape(local)


def brute_segmentation(words, scores):
    n, best = len(words), -math.inf
    starts = {i for i in range(n) if any(" ".join(words[i:j]) in scores for j in range(i + 1, n + 1))}
    for cut in itertools.product([0, 1], repeat=max(0, n - 1)):
        at = [0, *[i + 1 for i, c in enumerate(cut) if c], n]
        total = 0.0
        for a, b in zip(at, at[1:]):
            g = " ".join(words[a:b])
            if g in scores:
                total += scores[g]
            elif b - a == 1 and a not in starts:
                pass
            else:
                total = -math.inf
        best = max(best, total)
    return best


def test_viterbi_matches_enumeration():
    rng = random.Random(1)
    for _ in range(300):
        grams = {" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): -rng.random() * 5 for _ in range(rng.randint(0, 8))}
        words = [rng.choice("abcd") for _ in range(rng.randint(1, 8))]
        score, segs = segment.viterbi(words, segment.Trie(grams))
        expected = brute_segmentation(words, grams)
        if expected > -math.inf:
            assert score == pytest.approx(expected)
        assert [i for s, e, _ in segs for i in range(s, e)] == list(range(len(words)))


def test_toy_segments():
    trie = segment.Trie({"a": -3.0, "b": -3.0, "a b": -2.0})
    assert segment.viterbi(["a", "b"], trie) == (-2.0, [(0, 2, True)])
    assert segment.viterbi(["a", "b", "c"], trie) == (-2.0, [(0, 2, True), (2, 3, False)])
    assert segment.viterbi(["a", "b"], trie, punct=[False, True]) == (-6.0, [(0, 1, True), (1, 2, True)])


def test_segmentation_by_join_agrees(toy):
    p = quality.length_share(mining.frequent_grams(toy, 2, 3).withColumn("quality", F.lit(0.9)))
    scores = segment.scored_patterns(p)
    a = {r.sent_id: (r.score, r.segments) for r in segment.segmented(toy, scores).collect()}
    b = {r.sent_id: (r.score, r.segments) for r in segment.segmented(toy, scores, max_patterns=0).collect()}
    assert a == b


def test_tuple_path():
    heads, types, tags = [2, 0, 2, 2], ["nsubj", "root", "dobj", "nmod:tmod"], ["NNP", "VBD", "NNP", "NN"]
    assert tuples.paths(heads, types, tags, [(0, 1), (2, 3)]) == [(1, 0, [2])]
    assert tuples.ancestors(heads, 2) == [2] and tuples.exits(heads, 0, 1) == [(2, 1)]


def test_mentions():
    tokens, tags = "city of new york grows in may".split(), "NN IN NNP NNP VBZ IN NNP".split()
    assert mentions.mentions_of(tokens, tags, ["city", "of new york", "in may"]) == [(0, 4, "city of new york"), (6, 7, "may")]
    assert mentions.located(tokens, ["new york", "city"]) == [(2, 4)]


def test_chunks(spark):
    words = "the big dog saw new york in june".split()
    tags = "DT JJ NN VBD NNP NNP IN NNP".split()
    s = spark.createDataFrame([(0, words, tags)], "sent_id long, tokens array<string>, tags array<string>")
    got = [(r.st, r.n, r.text) for r in mentions.noun_chunks(s).orderBy("st").collect()]
    assert got == [(0, 3, "the big dog"), (4, 4, "new york in june")]


def test_phrases_between_all_pairs():
    """Against every pair of spans, gaps of any length included."""
    rng = random.Random(6)
    for k in range(300):
        tags = [rng.choice(["NN", "NNS", "VBD", "VBZ", "IN", "RP", "DT", "JJ", ".", "CD", "NNP"]) for _ in range(rng.randint(0, 40))]
        spans, at = [], 0
        while at < len(tags):
            n = rng.randint(1, 3)
            if rng.random() < 0.3:
                spans.append((at, min(len(tags), at + n)))
            at += n
        for legacy in (False, True):
            want = {}
            for _, e in spans:
                for s, _ in spans:
                    if s > e:
                        said = " ".join(tags[e:s]) + " " * (not legacy)
                        if m := supervise._FIRST(said):
                            first = e + said[: m.start()].count(" ")
                            key = (first, said[m.start() : m.end()].rstrip().count(" ") + 1)
                            want[key] = want.get(key, 0) + 1
            got = {}
            for first, n, times in supervise.phrases_between(tags, spans, legacy):
                got[first, n] = got.get((first, n), 0) + times
            assert got == want


def test_level_mining_against_counting(spark):
    rng = random.Random(8)
    lines = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))] for _ in range(400)]
    s = spark.createDataFrame([(i, w, w) for i, w in enumerate(lines)], "sent_id long, tokens array<string>, tags array<string>").repartition(3)
    count, first = {}, {}
    for i, w in enumerate(lines):
        for n in range(1, 6):
            for k in range(len(w) - n + 1):
                g = " ".join(w[k : k + n])
                count[g] = count.get(g, 0) + 1
                first.setdefault(g, []).append((i, k))
    p = mining.frequent_grams(s, 6)
    frequent = {g: c for g, c in count.items() if c >= 6}
    assert {r.gram: r.freq for r in p.collect()} == frequent
    occ = {}
    for r in mining.occurrences(s, p).collect():
        occ.setdefault(r.gram, []).append((r.sent_id, r.st))
    assert {g: sorted(v) for g, v in occ.items()} == {g: first[g] for g in frequent}
    assert {r.gram: r.tags for r in mining.first_tags(s, p).collect()} == {g: g for g in frequent}


def test_relations(spark):
    s = spark.createDataFrame([(0, "obama was born in hawaii".split(), "NNP VBD VBN IN NNP".split())], "sent_id long, tokens array<string>, tags array<string>")
    s = s.withColumn("chunks", F.expr("array(named_struct('st', 0, 'n', 1), named_struct('st', 4, 'n', 1))"))
    assert [(r.text, r.tags) for r in supervise.relation_phrases(s).collect()] == [("was born in", "VBD VBN IN")]
    assert [r.text for r in supervise.relation_phrases(s, legacy=True).collect()] == ["was born"]


def test_seeds_and_rank(spark):
    seeds = spark.createDataFrame([(1, "New York", 0.9, 0.0001), (1, "york", 0.8, 0.0001), (2, "x", 0.9, 0.001)], "doc long, surface string, sim double, second_rank double")
    assert [r.surface for r in supervise.confident_seeds(seeds).collect()] == ["New York"]
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("r", [0.0, 1.0]), ("s", [-2.0, 1.0])], "key string, vec array<double>")
    t = spark.createDataFrame([(1, "a", "b", ["r", "s"]), (2, "a", "none", ["r"]), (3, "a", "b", ["none"])], "tuple_id long, subj string, obj string, rels array<string>")
    assert [(r.tuple_id, r.score) for r in rank.translation_scores(t, emb, emb, 2).collect()] == [(1, 0.0)]


def test_evaluation(spark):
    a = spark.createDataFrame([(0, ["x", "y"]), (1, ["z"])], "sent_id long, phrases array<string>")
    b = spark.createDataFrame([(0, ["y", "w"]), (2, ["q"])], "sent_id long, phrases array<string>")
    assert [(r.only_a, r.only_b) for r in evaluate.differences(a, b).collect()] == [(["x"], ["w"])]
    r = evaluate.micro_counts(a, b).collect()[0]
    assert (r.n_pred, r.n_gold, r.n_both) == (2, 3, 1) and r.recall == pytest.approx(1 / 3)


def test_chunks_of_a_long_run_of_nouns(spark):
    """Java's matcher needed a deeper stack for each of them."""
    n = 60_000
    s = spark.createDataFrame([(7, ["x"] * n + [".", "y"], ["NN", "NNS"] * (n // 2) + [".", "NN"])], "sent_id long, tokens array<string>, tags array<string>")
    assert [(r.sent_id, r.st, r.n) for r in mentions.noun_chunks(s).collect()] == [(7, 0, n), (7, n + 1, 1)]


def test_relation_phrases_of_a_long_sentence():
    """Chunks behind which no relation stands were searched to the sentence's end each: 20,000 of them took minutes."""
    began = time.process_time()
    tags = ["NN", "."] * 20_000 + ["VBD", "IN", "NN"]
    spans = [(i, i + 1) for i, t in enumerate(tags) if t == "NN"]
    assert supervise.phrases_between(tags, spans) == [(40_000, 2, 20_000)]
    assert time.process_time() - began < 10


def test_scores_are_those_of_the_c_library(spark):
    """Java's logarithm differs in the last bit in some of these, which turns ties between segmentations."""
    rng = random.Random(15)
    rows = [(f"g{i}", 1, 1, rng.random(), rng.random()) for i in range(2000)]
    p = spark.createDataFrame(rows, "gram string, n int, freq long, share double, quality double")
    got = {r.gram: r.score for r in segment.scored_patterns(p).collect()}
    assert got == {g: math.log(s + 1e-8) + math.log(q + 1e-8) for g, _, _, s, q in rows}


def test_quality_rounds_as_sql_does(spark):
    from lexloom.plans.queries import _as_sql_rounds

    import duckdb

    rows = [(a, 2**i * 5**j) for i in range(5, 10) for j in range(1, 5) for a in range(1, 100, 2)]
    got = spark.createDataFrame(rows, "a long, b long").select(_as_sql_rounds(F.col("a") / F.col("b"), 6)).collect()
    assert [x for (x,) in got] == [duckdb.execute(f"SELECT round({a} / {b}, 6)").fetchone()[0] for a, b in rows]


def test_segmentation_against_a_trie(spark):
    rng = random.Random(14)
    sents = [(i, [rng.choice("abcde.") for _ in range(rng.randint(0, 30))]) for i in range(300)]
    grams = {" ".join(rng.choice("abcde.") for _ in range(rng.randint(1, 4))): float(rng.randint(-6, -1)) for _ in range(120)}
    s = spark.createDataFrame(sents, "sent_id long, tokens array<string>")
    scores = spark.createDataFrame(list(grams.items()), "gram string, score double")
    trie = segment.Trie(grams)
    for veto in (False, True):
        got = {r.sent_id: (r.score, [(x.st, x.ed + 1, x.known, x.gram) for x in r.segments]) for r in segment.segmented(s, scores, veto=veto).collect()}
        for i, w in sents:
            score, segs = segment.viterbi(w, trie, punct=[x == "." for x in w] if veto else None)
            assert got[i] == (score, [(a, b, k, " ".join(w[a:b])) for a, b, k in segs])


def test_ratios_context_and_idf_send_only_sums(spark):
    """Occurrences, their words and flags were joined and shuffled, many times the input; now their plans deal out sums by gram or word."""
    texts = ['(new york) "new york"', "a new york-new york", "", "NEW YORK city"]
    docs = spark.createDataFrame([(3, "\n".join(texts))], "doc_id long, text string")
    s = annotate.sentences(docs)
    p = spark.createDataFrame([("new york", 2, 5), ("york city", 2, 1)], "gram string, n int, freq long")
    r = features.punctuation_ratios(p, s)
    got = {x.gram: (x.quote, x.dash, x.parenthesis, x.first_cap, x.all_cap) for x in r.collect()}
    assert got == {"new york": (0.2, 0.0, 0.2, 0.2, 0.2), "york city": (0.0, 0.0, 0.0, 0.0, 0.0)}
    i = vocab.sentence_idf(s)
    assert {x.token: (x.df, x.idf) for x in i.collect()} == {x.token: (x.df, x.idf) for x in vocab.idf(annotate.tokens(s)).collect()}
    c = features.context_outside(p, annotate.texts(docs), i)
    # of new york four of five places see four of each word, the last only its own; york city sees one of each
    assert {x.gram: round(x.outside, 9) for x in c.where("outside IS NOT NULL").collect()} == pytest.approx({"new york": 2.4, "york city": 0.0})
    assert {x.gram: x.outside for x in features.context_outside(p, annotate.texts_of(s), i).collect()} == pytest.approx({x.gram: x.outside for x in c.collect()}, nan_ok=True)
    for df in (r, c, i):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and not any("sent_id" in x or "pos" in x for x in plan.split("\n") if "Join" in x or "Aggregate" in x)


def test_dependencies_are_those_of_the_columns(spark):
    from lexloom.plans import train

    rng = random.Random(4)
    rows = [(i, [rng.choice(["NN", "NNS", "VBD", "IN", "DT", "."]) for _ in range(rng.randint(1, 12))]) for i in range(200)]
    s = spark.createDataFrame(rows, "sent_id long, tags array<string>")
    x = train.with_heads(s).withColumn("d", annotate.rule_dependencies(F.col("tags")))
    assert all([(d.head, d.type) for d in r.d] == list(zip(r.heads, r.types)) for r in x.collect())


def test_tuple_paths_of_a_long_sentence():
    """Ancestors were compared word by word for every pair of mentions: the cube of the length."""
    tags = ["NN", "IN"] * 700 + ["VBD", "."] * 10
    heads, types = annotate.dependencies(tags)
    began = time.process_time()
    assert len(tuples.paths(heads, types, tags, [(i, i + 1) for i in range(0, 1400, 2)])) == 698
    assert time.process_time() - began < 10
