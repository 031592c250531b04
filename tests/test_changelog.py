"""Change tables: deletes, replays, late rows, compaction, and readers meanwhile."""

import random

import pytest
from pyspark.sql import functions as F

from graphquarry.sources.store import ConcurrentCommit, Manifest
from graphquarry.streaming.changelog import ChangeFeed, ChangeTable

SCHEMA = "id long, seq long, name string"
CHANGE = SCHEMA + ", op string"


@pytest.fixture
def feed(spark, tmp_path):
    table = ChangeTable(spark, f"file://{tmp_path}/t", "people", spark.createDataFrame([], SCHEMA).schema, ("id",), ("seq",), buckets=4, most_runs=3)
    return ChangeFeed(table, lambda: F.col("op") == "delete")


def rows(feed):
    return {(r.id, r.seq, r.name) for r in feed.read().collect()}


def test_random_changes(spark, feed):
    """Batches out of order, with repeats and deletions, against a dictionary."""
    rng, best, seq = random.Random(5), {}, list(range(400))
    rng.shuffle(seq)
    for batch in range(8):
        changes = [(rng.choice([None, *range(30)]), s, f"n{s}", rng.choice(["write", "write", "delete"])) for s in seq[batch * 50 : batch * 50 + 50]]
        feed.apply(spark.createDataFrame(changes, CHANGE), batch)
        for c in changes:
            best[c[0]] = max(best.get(c[0], c), c, key=lambda x: x[1])
        assert rows(feed) == {c[:3] for c in best.values() if c[3] != "delete"}
    before = rows(feed)
    feed.apply(spark.createDataFrame([(1, 10_000, "again", "write")], CHANGE), 7)
    assert rows(feed) == before
    feed.sweep(1)
    assert rows(feed) == before and feed.manifest.version() == 8


def test_ties_and_late_rows(spark, feed):
    feed.apply(spark.createDataFrame([(1, 5, "a", "write"), (1, 5, None, "delete"), (2, 5, "b", "write"), (3, 1, None, "delete")], CHANGE), 0)
    assert rows(feed) == {(2, 5, "b")}
    for batch in range(1, 6):
        feed.apply(spark.createDataFrame([(1, 4, "late", "write"), (3, 1, "equal", "write")], CHANGE), batch)
        assert rows(feed) == {(2, 5, "b")}
    feed.apply(spark.createDataFrame([], CHANGE), 6)
    assert rows(feed) == {(2, 5, "b")}


def test_only_full_buckets_are_rewritten(spark, feed):
    every = spark.createDataFrame([(i, 0, "x", "write") for i in range(100)], CHANGE)
    feed.apply(every, 0)
    one = spark.createDataFrame([(1, 1, "y", "write")], CHANGE)
    for batch in (1, 2):
        feed.apply(one.withColumn("seq", F.lit(batch).cast("long")), batch)
    state = feed.manifest.load()[1]["state"]
    assert len(state["base"]) == 1 and sum(map(len, state["runs"].values())) == 3
    assert (1, 2, "y") in rows(feed) and len(rows(feed)) == 100
    # Buckets without changes are read as they stand: no aggregate runs over their base.
    settled = feed.table.compact(state)
    assert "Aggregate" not in feed.table.read(settled)._jdf.queryExecution().executedPlan().toString()
    assert feed.table.read(settled).count() == 100


def test_a_reader_keeps_its_snapshot(spark, feed):
    feed.apply(spark.createDataFrame([(i, 0, "old", "write") for i in range(20)], CHANGE), 0)
    reader = feed.read()
    for batch in range(1, 5):
        feed.apply(spark.createDataFrame([(i, batch, "new", "write") for i in range(20)], CHANGE), batch)
    assert {r.name for r in reader.collect()} == {"old"} and {r[2] for r in rows(feed)} == {"new"}


def test_a_failed_batch_leaves_nothing(spark, feed):
    feed.apply(spark.createDataFrame([(1, 0, "a", "write")], CHANGE), 0)
    bad = spark.createDataFrame([(1, 1, "b", "write")], CHANGE).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        feed.apply(bad, 1)
    assert rows(feed) == {(1, 0, "a")}
    feed.apply(spark.createDataFrame([(1, 1, "b", "write")], CHANGE), 1)
    assert rows(feed) == {(1, 1, "b")}


def test_purged_tombstones(spark, feed):
    feed.apply(spark.createDataFrame([(1, 1, None, "delete"), (2, 9, None, "delete"), (3, 1, "c", "write")], CHANGE), 0)
    version, value = feed.manifest.load()
    state = feed.table.purge(value["state"], F.col("seq") < 5)
    assert {r.id for r in feed.table.changes(state).collect()} == {2, 3}


def test_two_writers(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.load() == (0, {})
    assert m.commit({"a": 1}, 0) == 1
    with pytest.raises(ConcurrentCommit):
        m.commit({"a": 2}, 0)
    assert m.load() == (1, {"a": 1})


def test_one_run_is_read_as_it_stands(spark, tmp_path):
    """Each key stands once in a run, so a table of one needs no aggregate, and columns are pruned in its scan."""
    schema = spark.createDataFrame([], "id long, v string, _seq long").schema
    table = ChangeTable(spark, f"file://{tmp_path}", "t", schema, ("id",), ("_seq",), 2)
    state = table.stage({}, spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema))
    assert {(r.id, r.v) for r in table.read(state).collect()} == {(1, "b"), (2, "c")}
    assert "Aggregate" not in table.read(state)._jdf.queryExecution().executedPlan().toString()
    again = table.stage(state, spark.createDataFrame([(2, "d", 3)], schema))
    assert {(r.id, r.v) for r in table.read(again).collect()} == {(1, "b"), (2, "d")}
