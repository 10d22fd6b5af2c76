import hashlib
import random
from collections import Counter

from hypothesis import given, settings, strategies as st

from lexloom.llm import substring_dedup, suffix_dedup


def brute_words(rows, k=13):
    first, out = {}, {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.setdefault(i, []).append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def brute_bytes(rows, length=400):
    count = Counter()
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if i is not None and count[b[j : j + length]] > 1:
                gone[j : j + length] = b"\x01" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_words_match_brute_force(docs, rows):
    expected = brute_words(rows)
    for options in ({}, {"listed": 1, "buckets": 1, "block_bytes": 500}, {"window": 13, "listed": 1, "block_bytes": 1 << 20}):
        got = {}
        for r in substring_dedup.dedup(docs, **options).collect():
            got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_bytes_match_brute_force(docs, rows):
    expected, got = brute_bytes(rows), {}
    for r in suffix_dedup.dedup(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_bytes_periodic(spark):
    rng = random.Random(5)
    rows = [(1, "a" * 1500), (2, "ab" * 500 + "c" * 450 + "ab" * 500), (3, "a" * 399), (4, "".join(rng.choice("ab") for _ in range(700)) * 2), (5, "x" * 400)]
    expected = brute_bytes(rows)
    for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))] == expected[r.doc_id]


def test_bytes_frequent_words_do_not_travel(spark):
    """Texts that have the same frequent words but no long string in common share no key, so none is sent or sorted."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(300)], "doc_id long, text string")
    found = suffix_dedup.stretches(docs, suffix_dedup.DEFAULTS)
    assert found.groupBy("key").count().where("count > 1").count() == 0 < found.count()


def test_bytes_frequent_passage_is_divided(spark, monkeypatch):
    """A passage of 260 bytes in many texts is a key with much text; no array gets all of it, and results stay exact."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    passage, tail = letters(260), letters(170)
    rows = [(i, letters(rng.randint(200, 500)) + passage + (tail if i % 4 == 0 else letters(rng.randint(0, 500)))) for i in range(60)] + [(60, "ab" * 700 + passage + "ab" * 700)]
    expected, sizes, sort = brute_bytes(rows), [], suffix_dedup.repeated_places
    monkeypatch.setattr(suffix_dedup, "repeated_places", lambda strings, weights, o: sizes.append(sum(map(len, strings))) or sort(strings, weights, o))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for bucket_bytes in (500, 5000, 2 << 20):
        for r in suffix_dedup.dedup(docs, bucket_bytes=bucket_bytes).collect():
            assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))] == [(r.doc_id, *x) for x in expected[r.doc_id]]
    o = suffix_dedup.DEFAULTS | {"bucket_bytes": 5000}
    group = [b"\x01" + i.to_bytes(8, "little") + bytes(4) + t.encode() for i, t in rows]
    list(suffix_dedup._resolve([group], o))
    assert sizes and max(sizes) < 0.3 * sum(len(t) for _, t in rows)


def test_empty_tables(no_docs):
    assert substring_dedup.dedup(no_docs).collect() == []
    assert suffix_dedup.dedup(no_docs).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_query_digest(spark, tmp_path, rows):
    spark.createDataFrame([r for r in rows if r[0] is not None][:13], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in substring_dedup.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[4] == hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got[8] == hashlib.sha256(b"one two").hexdigest()
