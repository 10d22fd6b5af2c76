import random

import pytest

#: Columns whose names the operators use for themselves.
CLASH = "runs string, key string, host string, text_key string, component_id string, path string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text: nulls, empties, a very long text, copies, near copies, ties, repeated rows."""
    base, long = prose(1, 120), prose(2, 9000)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    shared = prose(3, 70)
    out = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, "one two"), (9, "one two"),
        (10, f"{prose(4, 50)} {shared}\n{prose(5, 30)}"), (11, f"{prose(6, 20)}\n{shared} {prose(7, 30)}"), (12, "dup " * 600),
        (13, "naïve café — “quotes”  two  blanks\r\nß日本😀 " + shared), (None, base), (None, None), (1, base),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
