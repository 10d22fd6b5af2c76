"""Noun chunks counted, compared and added to patterns: odd rows, long runs, and what travels."""

import re

import duckdb
import pytest

import __spark_entry__
from lexloom.operators import mentions

QUERIES = ("np_chunks", "entity_counts", "external_patterns", "mention_sets_diff", "mention_prf", "frequency_bands")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with a run of 3,000 nouns, sentences without chunks, repeated chunks, blank lines and nulls."""
    at = tmp_path_factory.mktemp("chunks")
    text = ["The big dog saw New York in 1999.\nIn May, The Bank Of Spain and www.example.com", "tree " * 3000 + "\n" * 5, "42 . !\nÉtat de Grâce état Ñandú 7", "", None, "a dog, a dog, The dog\tof the dog the trees"] * 12
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", QUERIES)
def test_chunk_queries_agree_with_sql(spark, folder, name):
    got = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert expected and sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, expected))


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_sets_are_compared_in_the_sentences_row(spark, folder):
    """every chunk travelled twice, was gathered to sets by sentence twice, and the sets were joined."""
    for name in ("mention_sets_diff", "mention_prf"):
        plan = _plan(__spark_entry__.queries()[name](spark, folder))
        assert "Join" not in plan and "collect_set" not in plan and plan.count("MapInArrow") == 1, name


def test_only_counted_text_leaves_the_worker(spark, folder):
    """F7, F8, F12: chunks left the worker with their sentence, place and tags, to be counted by text alone."""
    for name in ("entity_counts", "frequency_bands", "external_patterns"):
        plan = _plan(__spark_entry__.queries()[name](spark, folder))
        assert re.search(r"MapInArrow run\(.*\)#\d+, \[text#\d+\]", plan), (name, plan)


def test_chunks_of_odd_rows(spark):
    """No tags, no words, tags not known, fewer words than tags; chunks never reach into the next row."""
    rows = [(1, None, None), (2, [], []), (3, ["a", "b"], ["NN", "XNN"]), (4, ["the"], ["DT", "NN"]), (5, ["x", "y", "z"], ["NNP", "CD", "NNS"]), (None, ["x", "x"], ["NN", "DT"]), (6, ["go"], ["VB"]), (7, ["n", ",", "n"], ["NN", ".", "NN"])]
    s = spark.createDataFrame(rows, "sent_id long, tokens array<string>, tags array<string>").coalesce(1)
    chunks = [(3, 0, 1, "a", "NN"), (4, 0, 2, "the", "DT NN"), (5, 0, 2, "x y", "NNP CD"), (5, 2, 1, "z", "NNS"), (None, 0, 1, "x", "NN"), (7, 0, 1, "n", "NN"), (7, 2, 1, "n", "NN")]
    assert [tuple(r) for r in mentions.noun_chunks(s).collect()] == chunks
    assert [r.text for r in mentions.chunk_texts(s).collect()] == [c[3] for c in chunks]
    assert [r.text for r in mentions.chunk_texts(s, 2).collect()] == ["the", "x y"]
    assert [tuple(r) for r in mentions.chunk_sets(s).collect()] == [(3, ["a"], []), (4, ["the"], ["the"]), (5, ["x y", "z"], ["x y"]), (None, ["x"], []), (7, ["n"], [])]
    assert mentions.noun_chunks(s.where("false")).collect() == [] == mentions.chunk_sets(s.where("false")).collect()
