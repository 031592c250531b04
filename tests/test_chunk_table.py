"""The chunk table of DataFrames against semantic_chunks, text by text."""

import random

import pytest

from graphquarry.functions import text as X

PIECES = ["a", "bc. ", "! ", "?", "\n\n", "\n \n", "\r\n", "\r", " ", " ", "\x1c", "\x85", "é", "😀", "wordy ", "\n", "....  ", "\x0b", "x" * 30]


@pytest.mark.parametrize("size, overlap", [(50, 10), (30, 29), (40, 100), (1000, 200)])
def test_equals_the_plain_function(spark, size, overlap):
    r = random.Random(size)
    texts = [None, "", " \n ", "\n" * 80, "z" * 90 + " " * 90 + "y", *("".join(r.choices(PIECES, k=r.randint(1, 120))) for _ in range(200))]
    got = {}
    for row in X.chunk_table(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", size, overlap).orderBy("id", "chunk_index").collect():
        assert row.chunk_index == len(got.setdefault(row.id, []))
        got[row.id].append((row.total_chunks, row.content))
    want = {i: [(len(cs), c) for c in cs] for i, t in enumerate(texts) if (cs := X.semantic_chunks(t, size, overlap))}
    assert got == want


def test_python_gets_numbers_only(spark):
    """Texts of any length stay in Spark, so a batch of large ones doesn't fill a Python worker."""
    df = spark.createDataFrame([(1, "a b. c")], "id long, some_text string")
    plan = X.chunk_table(df, "id", "some_text")._jdf.queryExecution().analyzed().toString()
    calls = [line for line in plan.splitlines() if "places(" in line]
    assert calls and not any("some_text" in line for line in calls)
