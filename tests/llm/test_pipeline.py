import re

import corpus_pipeline
from lexloom.llm import decontaminate, secrets
from tests.llm.conftest import prose
from tests.llm.test_filters import brute_metrics
from tests.llm.test_near import brute_components


def test_run_against_brute_force(spark, tmp_path, rows):
    bench = prose(31, 40)
    rows = [r for r in rows if r[0] is not None][:13]
    rows += [(50, f"{prose(51, 30)} {bench} {prose(52, 30)}"), (51, f"{prose(53, 40)} token = \"abcdef0123456789\" {prose(54, 10)}")]
    spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in rows if not brute_metrics(t)[-1]]
    kept = [(i, t) for i, t in kept if (i, i) in {(a, c) for a, _, c in brute_components(kept, 5)}]
    item = decontaminate.normalised(bench)
    kept = [(i, t) for i, t in kept if item not in b" ".join(decontaminate.normalised(t).split())]
    kept = {i: secrets.redact(t, secrets.find(t)[1]) for i, t in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(kept) and all(r.round_trips and len(r.ids) == r.n_tokens for r in got)
    import hashlib

    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    assert 50 not in kept and re.search(r"\[assign\]", kept[51])


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, prose(31, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
