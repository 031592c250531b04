import pytest
from pyspark.sql import functions as F

from graphquarry.operators import insights
from graphquarry.plans.steps import Steps


def test_chain(spark):
    put = lambda x: lambda d: d.withColumn("log", F.concat("log", F.lit(x)))
    chain = Steps().add("b", put("b"), 20).add("a", put("a"), 10).add("c", put("c"), 20)
    df = spark.createDataFrame([("",)], "log string")
    seen = lambda: chain.run(df).first().log
    assert seen() == "abc" and chain.names() == ["a", "b", "c"] and "b" in chain
    chain.before("b", put("<")).after("b", put(">")).replace("b", put("B"))
    assert seen() == "a<B>c"
    assert chain.remove("b").run(df).first().log == "ac"
    for wrong in (lambda: chain.add("a", put("x")), lambda: chain.remove("b"), lambda: chain.before("z", put("x"))):
        with pytest.raises((KeyError, ValueError)):
            wrong()
    assert Steps().run(df).first().log == ""


def test_labels(spark):
    df = spark.createDataFrame([(None, True, 1.5, "x" * 51, "2024-01-02T03", {"k": 1}), (3, None, None, "it", None, None)], "i int, b boolean, f double, s string, d string, m map<string,int>")
    a, b = (tuple(r) for r in insights.labelled(df).collect())
    assert a == ("null", "true (boolean)", "1.5 (float)", f"'{'x' * 47}...' (string)", "'2024-01-02T03' (string date - compare as: property < '2024-01-02T03')", '{"k":1} (array)')
    assert b == ("3 (integer)", "null", "null", "'it' (string)", "null", "null")
    table = insights.as_table(df.select("i", "s"), 1).first()
    assert table.headers == ["i", "s"] and table.rows == [[None, "x" * 51]]
    assert insights.as_table(df.limit(0)).first().rows == []
