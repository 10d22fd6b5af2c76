import random

from lexloom.llm import components, decontaminate, near_dup
from tests.llm.conftest import prose


def brute_components(rows, k=4):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[n] = (i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    items = [x for x in sets.values() if x[0] is not None]
    for a, s in items:
        for b, t in items:
            if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i) if i is not None else None) for i, s in sets.values()}


def test_matches_brute_force(docs, rows, no_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, shingle=4).collect()}
    assert got == brute_components(rows)
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_large_groups_are_branched(spark):
    """A group of near copies far beyond node_shingles keeps its component."""
    rng, words, rows = random.Random(4), prose(11, 200).split(), []
    for i in range(160):
        w = list(words)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(200)] = f"w{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(500 + i, 80)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    for limit in (3_000_000, 4_000):
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, shingle=4, node_shingles=limit).collect()} == expected


def test_oversized_nodes_are_compared_whole(spark):
    """Pairs at about the threshold, in groups whose nodes are nearly all beyond node_shingles, are all found."""
    rng, base, rows = random.Random(21), prose(21, 200).split(), []
    for i in range(150):
        w = list(base)
        for j in (0, 1):
            for at in rng.sample(range(200), 4):
                w[at] = f"w{i}-{j}-{at}"
            rows.append((2 * i + j, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    assert len({c for _, _, c in expected}) > 100
    got = near_dup.near_duplicates(df, shingle=4, node_shingles=4_000, trees=6, depth=1, levels=1).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == expected


def test_linked_by_label_and_side():
    import numpy as np

    a, b, c = np.arange(20), np.arange(1, 21), np.arange(100, 120)
    assert near_dup.linked([a, b, c], 80) == [0, 0, 2]
    assert near_dup.linked([a, c, b], 80, [7, 7, 9], [1, 1, 2]) == [0, 0, 0]
    assert near_dup.linked([a, b, c], 80, [1, 2, 3], [1, 1, 2]) == [0, 1, 2]


def test_kept_documents(docs):
    kept = near_dup.kept_documents(docs, shingle=4)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids and 4 in ids and ids.count(None) == 2


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (10, 11), (11, 12), (7, 7)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got[i] for i in (2, 3, 4, 5, 10, 11, 12)] == [2, 2, 2, 2, 10, 10, 10] and {got[i] for i in range(100, 140)} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, no_docs):
    a, b = prose(31, 40), prose(32, 25)
    words = a.split()
    bench = [(1, a), (2, b), (3, None), (4, "too short"), (5, a)]
    items = spark.createDataFrame(bench, "item_id long, text string")
    rows = [
        (1, f"{prose(33, 100)} {a} {prose(34, 100)}"), (2, a.upper().replace(" ", ", ")), (3, " ".join([*words[:20], *words[24:]])),
        (4, " ".join([*words[:39], "else"])), (5, prose(35, 300)), (6, None), (7, ""), (8, " ".join(words[:12])), (None, b), (9, f"{a} {b}"),
    ]
    held = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    for words_a_block in (1_000_000, 30):
        got = {(r.doc_id, r.item_id) for r in decontaminate.matches(held, items, block_words=words_a_block).collect()}
        assert got == {(1, 1), (1, 5), (2, 1), (2, 5), (4, 1), (4, 5), (None, 2), (9, 1), (9, 2), (9, 5)}
    assert {r.doc_id for r in decontaminate.clean_documents(held, items).collect()} == {3, 5, 6, 7, 8, None}
    assert decontaminate.matches(no_docs, items).count() == 0
    assert decontaminate.matches(held, items.where("item_id > 99")).count() == 0


def test_multi_index_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2, (400, decontaminate.BITS), dtype=np.uint8)
    for radius in (decontaminate.radius_for(0.8), 110, 127, 200):
        index = decontaminate.MultiIndex(fp, radius)
        for q in [*rng.integers(0, 2, (20, decontaminate.BITS), dtype=np.uint8), *(fp[:20] ^ (rng.random((20, decontaminate.BITS)) < 0.25))]:
            assert index.near(q).tolist() == np.flatnonzero((fp != q).sum(1) <= radius).tolist()
    index = decontaminate.MultiIndex(fp, decontaminate.radius_for(0.8))
    assert sum(len(index.candidates(q)) for q in rng.integers(0, 2, (100, decontaminate.BITS), dtype=np.uint8)) < 40  # of 40,000


def test_decontamination_against_every_window(spark):
    """All windows of an item's size against all items by weighted similarity; short items are whole texts."""
    from collections import Counter

    rng = random.Random(8)
    said = [prose(400 + i, 30).split() for i in range(6)]
    bench = [(i, " ".join(w)) for i, w in enumerate(said)] + [(6, "a b c a b c a b c a b c"), (7, "one two three"), (8, "word"), (9, "")]
    rows = [(100, "One, two three!"), (101, "one two three four"), (102, "say one two three"), (103, "word"), (104, "word word"), (105, None), (106, "")]
    for i in range(60):
        w = list(rng.choice(said))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["", "else", "of the"])
        rows.append((i, f"{prose(500 + i, rng.randint(0, 40))} {' '.join(w)} {'a b c ' * rng.randint(0, 6)} {prose(600 + i, rng.randint(0, 9))}"))
    rows += [(107, rows[10][1]), (107, rows[10][1]), (108, f"{prose(1, 40000)} {bench[0][1]} {prose(2, 40000)}")]

    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])

    expected = []
    for d, t in rows:
        words = decontaminate.normalised(t).split()
        for j, item in bench:
            b = decontaminate.normalised(item).split()
            best = 0.0
            want = bag(b)
            for s in range(max(1, len(words) - len(b) + 1) if len(b) >= 5 else 1):
                got = bag(words[s : s + len(b)] if len(b) >= 5 else words)
                if both := sum((got & want).values()):
                    best = max(best, both / sum((got | want).values()))
            if best >= 0.8:
                expected.append((d, j, round(best, 9)))
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for block_words in (1_000_000, 60):
        got = decontaminate.matches(df, items, block_words=block_words).collect()
        assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == sorted(expected)
    assert {j for _, j, _ in expected} >= {0, 6, 7, 8}
