"""The entry module: what it registers and that its SQL covers it."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


def test_sql_is_text():
    assert [n for n, q in __spark_entry__.oracle_sql().items() if not isinstance(q, str)] == []


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "lexloom").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p


def test_sql_agrees_at_the_smallest_scale(spark, tmp_path):
    """A few queries against DuckDB on a small table; the driver runs all of them."""
    import duckdb

    text = ["The big dog.\nA small cat (in \"New York\") - it is loved, 42 times.", "the big dog\nThe big dog!", "", "New York is big."] * 6
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(text)], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("ngram_mining", "token_flags", "completeness", "np_chunks", "vocab_first_seen"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, expected)), name
