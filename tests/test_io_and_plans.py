import pytest
from pyspark.sql import functions as F

from lexloom.operators import annotate, mining, quality, segment
from lexloom.plans import extract, train
from lexloom.sources import readers, writers
from lexloom.streaming import segmenter


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_corpus_files(spark, tmp_path):
    tok = _write(tmp_path, "t.txt", "a b c\r\nd e\nf\n")
    tag = _write(tmp_path, "p.txt", "NN VB NN\nNN NN\nNN NN\n")
    dep = _write(tmp_path, "d.txt", "0_2_nsubj 1_0_root 2_2_dobj\n0_0_root 1_1_dep\n0_0_root\n")
    ok, bad = readers.corpus(spark, tok, tag, dep)
    assert [(r.sent_id, r.tokens) for r in ok.orderBy("sent_id").collect()] == [(0, ["a", "b", "c"]), (1, ["d", "e"])]
    assert [r.sent_id for r in bad.collect()] == [2]
    assert ok.orderBy("sent_id").first().deps[0].asDict() == {"idx": 0, "head": 2, "type": "nsubj"}


def test_lines_of_folders(spark, tmp_path):
    """The files of a folder are numbered by path, whatever their sizes (the scan takes the largest first)."""
    (tmp_path / "f").mkdir()
    _write(tmp_path / "f", "part-0", "a\nb\n")
    _write(tmp_path / "f", "part-1", "c" * 5000 + "\nd\n")
    assert [(r.line_no, r.line[0]) for r in readers.lines(spark, f"{tmp_path}/f").orderBy("line_no").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_small_files(spark, tmp_path):
    assert [(r.label, r.gram) for r in readers.expert_labels(spark, _write(tmp_path, "e", "1 3 4\n0 7\n\n")).orderBy("label").collect()] == [(0, "7"), (1, "3 4")]
    assert {r.gram for r in readers.dictionary(spark, _write(tmp_path, "q", "1 2\n3 x 4\n5 -1\n")).collect()} == {"1 2", "3 4"}
    assert [(r.section, r.tag) for r in readers.prune_list(spark, _write(tmp_path, "l", "===unigram===\nDT\n===expansion===\nCC\nDT\n")).collect()] == [("unigram", "DT"), ("expansion", "CC"), ("expansion", "DT")]
    assert [(r.gram, r.tags) for r in readers.external_patterns(spark, _write(tmp_path, "b", "1_NN 2_NNS\n")).collect()] == [("1 2", "NN NNS")]
    assert [(r.key, r.vec) for r in readers.embeddings(spark, _write(tmp_path, "v", "1 2\nx 0.5 1.5 \n")).collect()] == [("x", [0.5, 1.5])]
    m = readers.entity_positions(spark, _write(tmp_path, "m", "0_1 2_4\n")).first().mentions
    assert [(x.start, x.end) for x in m] == [(0, 1), (2, 4)]
    assert readers.tagged_text(spark, _write(tmp_path, "g", "a_b_NN c_VB\n")).first().tokens == ["a_b", "c"]
    assert [r.token_id for r in readers.stopword_ids(spark, _write(tmp_path, "s", "4\nx\n")).collect()] == [4]


def test_json_and_xml(spark, tmp_path):
    j = _write(tmp_path, "s.json", '{"tokens":["a"],"pos":["NN"],"entityMentions":[[0,1,"a"]]}\n')
    assert readers.sentence_json(spark, j).first().mentions[0].text == "a"
    x = _write(tmp_path, "x.xml", "<r><entity ID='1'><name>n</name></entity><entity ID='2'><name>m</name></entity></r>")
    assert readers.xml_rows(spark, x, "entity").count() == 2


@pytest.fixture(scope="module")
def corpus(spark):
    lines = ["the big dog chased a small cat in new york", "a small cat was loved in new york by the big dog", "new york loved the big dog and a small cat"] * 12
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    return docs, train.with_heads(annotate.sentences(docs))


def test_train_and_extract(spark, corpus, tmp_path):
    _, sents = corpus
    entities = spark.createDataFrame([("new york",), ("big dog",), ("dog",), ("york",)], "gram string")
    relations = spark.createDataFrame([("loved",), ("chased a",), ("in",)], "gram string")
    patterns, priors = train.train(sents, entities, relations, train.Options(iterations=1, min_sup=10, max_len=3, num_trees=5, max_depth=5, prior_rounds=2))
    rows = patterns.collect()
    assert {r.label for r in rows} == {0, 1, 2} and all(0 <= r.quality <= 1 and r.indicator in quality.INDICATORS for r in rows)
    writers.save_model(f"{tmp_path}/m", patterns, priors)
    p, q = writers.load_model(spark, f"{tmp_path}/m")
    assert p.count() == len(rows) and q.count() > 0
    out = extract.extract(sents, p, q)
    assert out.columns == ["sent_id", "subj", "rels", "obj"] and out.count() >= 0
    writers.results(p.select("gram", "n", "freq", "quality", "indicator"), f"{tmp_path}/lists")
    assert spark.read.parquet(f"{tmp_path}/lists").count() == len(rows)


def test_stream_equals_batch(spark, corpus, tmp_path):
    docs, sents = corpus
    full = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    full.write.parquet(f"{tmp_path}/in")
    p = quality.length_share(mining.frequent_grams(sents, 10, 3).withColumn("quality", F.lit(0.8)))
    scores = segment.scored_patterns(p)
    q = segmenter.start(segmenter.segmented_stream(segmenter.documents_stream(spark, f"{tmp_path}/in"), scores), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {r.sent_id: r.score for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.sent_id: r.score for r in segment.segmented(sents, scores).collect()}
