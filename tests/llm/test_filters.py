import itertools
import math
import random
import re

import public_tokenizers
import pytest

from lexloom.llm import quality, secrets, toxicity, url_filter
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_metrics(docs, rows, no_docs):
    got = sorted(((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect()))
    assert got == sorted((i or -1, *brute_metrics(t)) for i, t in rows)
    assert quality.judge(no_docs).count() == 0


def test_repeats(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["a b\n" * 12, "x\n\nx\n y #|"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect()}
    assert got == {i: brute_metrics(t) for i, t in enumerate(texts)}


def test_frequent_lines(spark):
    line = "all rights are reserved by the owner of this page and by nobody else at all"
    rows = [(i, f"{prose(i, 30)}\n{line}", "hot", 1) for i in range(40)] + [(100, f"{line}\n{prose(700, 6)}\n{prose(701, 6)}", "hot", 1), (200, f"{line}\n{prose(702, 7)}", "other", 1), (101, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, frequent int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not got[100].base_failed and not got[100].kept and got[0].kept and got[0].n_frequent_words == 16
    assert got[200].kept and not got[101].kept  # elsewhere the line is rare; null has no words
    kept = {r.doc_id: r.text for r in quality.kept_documents(df).collect()}
    assert kept[3] == prose(3, 30) and kept[200].startswith(line) and 100 not in kept


def brute_frequent(rows):
    """Words of frequent lines of each document, by the definition: distinct texts of a host with the line, against its distinct texts."""
    norm = lambda x: " ".join(x.lower().split())
    texts = {}
    for _, t, h in rows:
        texts.setdefault(h, set()).add(t or "")
    above = set()
    for h, ts in texts.items():
        held = {}
        for t in ts:
            for x in {norm(x) for x in t.split("\n")} - {""}:
                held[x] = held.get(x, 0) + 1
        above |= {(h, x) for x, n in held.items() if n >= 20 and (n > 0.02 * len(ts) or n >= 200)}
    return sorted((i, sum(len(x.split()) for x in (t or "").split("\n") if (h, norm(x)) in above)) for i, t, h in rows)


def test_frequent_lines_against_brute_force(spark, no_docs):
    """Lines in 5 %, 1 % and 0.5 % of large hosts, copies of one text, a host without a name, very long and empty texts."""
    rng = random.Random(5)
    rows = [(i, "\n".join([prose(i, 9), *(["A  line\tof five percent"] if i % 20 == 0 else []), *(["one of a hundred"] if i % 100 == 1 else [])]), "big") for i in range(1500)]
    rows += [(5000 + i, f"{prose(1, 12)}\ncopied line here", "copies") for i in range(60)]
    rows += [(6000 + i, f"{rng.random()}\n one  footer \n" * 3, None) for i in range(25)] + [(7000, None, None), (7001, "", "big"), (7002, prose(9, 30_000) + "\na line of FIVE percent", "big"), (7002, "a line of five percent", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.n_frequent_words) for r in quality.judge(df).collect()) == brute_frequent(rows)
    assert quality.judge(df.drop("source")).count() == len(rows) and quality.kept_documents(no_docs).count() == 0
    # however large the host, max_docs texts are enough
    assert {r.n_frequent_words for r in quality.judge(df, max_share=0.5, max_docs=70).where("doc_id % 20 = 0 AND doc_id < 1500").collect()} == {5}


def test_secret_base_spans():
    f = lambda t: secrets.said(secrets.base_spans(t))
    assert f('x token = "abcdefgh1" y') == "assign:2:20"
    assert f("token = token = abcdefgh1") == "" and f("PASSWORD:short") == "" and f("api-key: 12345678") == ""
    assert f("ApiKey:12345678 é AKIA" + "B" * 12) == "assign:0:15,access:18:34"
    assert f("0123456789abcdef" * 2) == "hex:0:32" and f("0" * 31) == ""
    assert f("secret=" + "a" * 32) == "assign:0:39,hex:7:39"


def test_guess_costs():
    assert secrets.guess_bits("") == 0 and secrets.guess_bits("password123") < 20 and secrets.guess_bits("20240131") < 20
    assert secrets.guess_bits("qwertyuiop") < 20 and secrets.guess_bits("aaaaaaaaaaaa") < 20
    assert secrets.guess_bits("x9Kq2LmZ0pRt") > 60
    base, every = secrets.find("pwd: x9Kq2LmZ0pRt and pwd: Summer2024 and password=x9Kq2LmZ0pRt1")
    assert [s[2] for s in base] == [0] and secrets.said(every).startswith("guess:5:17,assign:")
    assert secrets.find(None) == ([], [])


def brute_guess_bits(value, ranks):
    """The least over all segmentations, each span at its cheapest kind; neighbours' spans of brute force are one span."""
    low, per_char = value.lower(), secrets.alphabet_bits(value)

    def bits(a, b):
        x, n, out = low[a:b], b - a, [per_char * (b - a)]
        for word, extra in ((x, 0), (x.translate(secrets.LEET), 1)):
            if n > 1 and word in ranks:
                v = value[a:b]
                out.append(math.log2(ranks[word] + 1) + extra + (0 if v.islower() else 1 if v.istitle() or v.isupper() else n))
        if (m := secrets.DATE.match(value, a)) and m.end() == b:
            out.append(secrets.DATE_BITS)
        pairs = list(zip(x, x[1:]))
        if n >= 3 and (all(p == q for p, q in pairs) or all(p + q in secrets.neighbours() for p, q in pairs) or all(abs(ord(p) - ord(q)) == 1 and p.isalnum() and q.isalnum() for p, q in pairs)):
            out.append(per_char + 1.5 * math.log2(n))
        for p in range(2, 9):
            if n >= 2 * p and all(x[i] == x[i + p] for i in range(n - p)) and (b == len(low) or low[b] != low[b - p]):
                out.append(p * per_char + 1.5 * math.log2(n / p))
        return secrets.SWITCH_BITS + min(out)

    n = len(value)
    cuts = ([0, *c, n] for k in range(n) for c in itertools.combinations(range(1, n), k))
    return min(sum(bits(a, b) for a, b in zip(c, c[1:])) for c in cuts) if n else 0.0


def test_guess_costs_against_all_segmentations():
    rng = random.Random(11)
    ranks = secrets.dictionary(None)[0]
    parts = ["pass", "P4ss", "key", "2024", "1999-12-31", "qwe", "aaa", "abc", "xyxy", "K", "7", "!", "zq"]
    values = {"".join(rng.choice(parts) for _ in range(5))[: rng.randint(1, 10)] for _ in range(120)}
    for v in values:
        assert abs(secrets.guess_bits(v) - brute_guess_bits(v, ranks)) < 1e-9, v


def test_long_values_are_costed_whole():
    rng = random.Random(9)
    value = "".join(rng.choice("abcdefGHIJKL0123456789") for _ in range(2000))
    assert secrets.find(f"pwd: {value} end")[1] == [(5, 2005, 3)]
    assert secrets.guess_bits("aB1" + "a" * 100_000) < 80


def test_values_around_the_costs():
    words = public_tokenizers.path("byte_bpe_50k.tiktoken")
    shown = lambda t: secrets.redact(t, secrets.find(t, words)[1])
    assert shown("password: Abcdefgh1!xYz#9") == "[assign]"
    assert shown("pwd: hGtRwQzXbNmKpLvC") == "pwd: [guess]" and shown("pwd: Required, Login: Facebook") == "pwd: Required, Login: Facebook"
    assert shown("login password x9Kq2LmZ0pRt") == "login password [guess]" and shown("the secret is x9Kq2LmZ0pRt.") == "the secret is [guess]."
    assert shown("Authorization: Bearer kfjqzhvnwtrxbmpl") == "Authorization: Bearer [guess]"
    assert shown("pwd=" * 200) == "pwd=" * 200 and len(secrets.find("pwd=" * 20_000)[1]) <= 1
    plain = "login with Understanding2020, passphrase Elephant12, token = Mississippi, the password requirements"
    assert shown(plain).replace("[assign]", "token = Mississippi") == plain
    assert secrets.said(secrets.find("token = Xk29vQ7pLm", words)[1]) == "assign:0:18,guess:8:18"  # a base value is costed too


def test_secret_operators(spark, docs, rows, no_docs):
    assert secrets.scan(docs).where("spans <> ''").count() == 0 and secrets.scan(docs).count() == len(rows)
    assert secrets.scan(no_docs).count() == 0
    df = spark.createDataFrame([(1, "a token=abcdefgh1 b", 18), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redacted_documents(df).orderBy("doc_id").collect()] == [(1, "a [assign] b", 12), (2, None, None)]


def brute_segments(scores):
    """Maximal segments by the recursive definition."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j)
    if best is None:
        return []
    s, i, j = best
    return brute_segments(scores[:i]) + [(i, j, s)] + [(a + j + 1, b + j + 1, t) for a, b, t in brute_segments(scores[j + 1 :])]


def test_maximal_segments():
    rng = random.Random(7)
    for _ in range(300):
        scores = [rng.choice([-0.5, -0.5, 1.0 + rng.random()]) for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.5)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_toxicity_held_out(spark, no_docs):
    rng, rows, marks = random.Random(3), [], []
    for i in range(600):
        words = prose(i, 60).split()
        if i % 5 == 0:
            for _ in range(6):
                words[rng.randrange(60)] = rng.choice(["scumbag", "scumlord", "vilest"])
        rows.append((i, " ".join(words), "x"))
        marks.append((i, 1, int(i % 5 == 0)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "scumbag", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, passages string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}
    assert toxicity.score(no_docs, labels).count() == 0
    value = lambda rows: sorted(map(str, rows))
    assert value(toxicity.score(df, labels, block_terms=7).collect()) == value(got)  # several blocks of terms, nothing left out
    long = spark.createDataFrame([(0, " ".join(prose(700 + k, 60) for k in range(2000))), *[(7, prose(1, 60))] * 3, (None, None)], "doc_id long, text string")
    again = toxicity.score(df.unionByName(long, allowMissingColumns=True), labels).collect()
    assert len(again) == len(got) + 5 and len({r.score for r in again if r.doc_id == 7 and r.passages == []}) <= 1
    assert {r.score for r in toxicity.score(df, labels.where("doc_id < 0")).collect()} == {0.0}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://a.example.com/fr/", "a.example.com", "/fr/", "com/", "allow"),
        ("https://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
        ("https://notexample.com", "notexample.com", "", None, "allow"),
        ("ftp://x.net?q=/es/", "x.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://x.org/a://b", "x.org", "/a://b", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, rule string")
    r = url_filter.judge(pages, spark.createDataFrame([], "doc_id long, quality int")).collect()[0]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_reputation(spark):
    pages = [(i, f"http://bad.example.org/{i}") for i in range(40)] + [(100 + i, f"http://good{i % 7}.other.org/{i}") for i in range(60)] + [(500, "http://new.example.org/"), (501, "http://new.other.org/")]
    labels = [(i, 0, 0) for i in range(40)] + [(100 + i, 1, 0) for i in range(60)] + [(None, 0, 0), (100, None, 0)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[0].verdict == "block" and got[100].verdict == "allow" and got[501].verdict == "allow"
    assert got[500].bad_bound > got[501].bad_bound  # a new host takes after its domain
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
