"""Deep pages and global ranks."""

import random

from pyspark.sql import functions as F

from graphquarry.operators import query


def test_any_page(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.5, float(i)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, `a.b` double")
    order = (F.col("`a.b`").desc_nulls_last(), F.col("id"))
    want = [r.id for r in df.orderBy(*order).collect()]
    ranges = query.Ranges(df, *order, ranges=7)
    assert ranges.total == 1000 and len(ranges.counts) == 7 and max(ranges.counts.values()) < 400
    for offset, n in ((0, 5), (137, 50), (990, 50), (0, 1000), (1000, 5), (495, 300)):
        assert [r.id for r in ranges.slice(offset, n).collect()] == want[offset : offset + n]
    assert {r.id: r.rank for r in ranges.ranked().collect()} == {x: i + 1 for i, x in enumerate(want)}
    plan = ranges.slice(500, 3)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters", 1)[1][:120]
    monkeypatch.setattr(query, "DEEP", 100)
    page = query.paginate(df, 6, 90, *order)
    assert [r.id for r in page.rows.collect()] == want[450:540] and (page.last_page, page.total) == (12, 1000)


def test_no_rows(spark):
    empty = query.Ranges(spark.createDataFrame([], "id int"), "id", ranges=3)
    assert empty.total == 0 and empty.slice(0, 5).collect() == [] and empty.ranked().collect() == []


def test_last_row_of_a_node_counts(spark):
    df = spark.createDataFrame([(1, 5, "new"), (1, 2, "old"), (2, 1, "only")], "id int, seq int, name string")
    got = {r.id: r.properties["name"] for r in query.graph_nodes(df, "N", "id", "seq").collect()}
    assert got == {"1": "new", "2": "only"}
