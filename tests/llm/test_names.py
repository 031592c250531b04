"""Columns whose names hold dots or backquotes pass through every stage that keeps rows."""

import pytest
from pyspark.sql import functions as F

from graphquarry.llm import decontaminate, mixing, neardup, quality

TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here on a bright cold day in april"


@pytest.fixture(scope="module")
def odd(make):
    rows = [(1, TEXT), (2, TEXT), (3, TEXT.replace("fox", "cat and another long story of its own that differs in nearly all words")), (None, None)]
    return make(rows).withColumn("a.b", F.col("doc_id") * 2).withColumn("c`d", F.lit("x")).withColumn("select", F.lit(1))


@pytest.mark.parametrize("stage", ["quality", "neardup", "decontaminate", "mixing"])
def test_odd_names(spark, odd, stage):
    items = spark.createDataFrame([("i", "never seen words of a benchmark item that nobody copied at all")], "item_id string, text string")
    run = {"quality": quality.keep, "neardup": neardup.near_dedup, "decontaminate": lambda d: decontaminate.clean(d, items), "mixing": mixing.take}[stage]
    out = run(odd)
    assert out.columns == odd.columns
    for r in out.collect():
        assert r["a.b"] == (None if r.doc_id is None else 2 * r.doc_id) and r["c`d"] == "x"
