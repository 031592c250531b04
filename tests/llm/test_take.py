"""take() against the mix, row by row."""

from collections import Counter

from graphquarry.llm import mixing


def test_rows_that_share_an_id_take_their_own_copies(make):
    rows = [(None if i % 2 else 7, f"r{i} " + "w " * (9 + i % 3), "en", "a" if i < 4 else "b") for i in range(40)]
    docs = make(rows)
    plan = mixing.mix(docs).collect()
    words = Counter()
    for r in mixing.take(docs).collect():
        words[r.source, r.doc_id, len(r.text.split())] += 1
    want = Counter()
    for r in plan:
        want[r.source, r.doc_id, r.size] += r.copies
    assert words == +want
    assert len({r.copies for r in plan}) > 1


def many(make, monkeypatch=None):
    """Nearly all rows without an id: some all alike, some of their own text."""
    rows = [(None, "one two three", "en", "a")] * 300 + [(None, f"row {i} " + "w " * (i % 9), "en", "a") for i in range(300)]
    return make(rows + [(i, f"other {i}", "en", "b") for i in range(80)])


def test_rows_without_ids_are_split(make, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 20)
    docs = many(make)
    plan = mixing.mix(docs).collect()
    assert len(plan) == 680
    want, words, got = Counter(), Counter(), Counter()
    for r in plan:
        want[r.source, r.doc_id, r.size] += r.copies
        words[r.source] += r.taken
    for r in mixing.take(docs).collect():
        got[r.source, r.doc_id, len(r.text.split())] += 1
    assert got == +want
    target = {r.source: r.target for r in plan}
    assert all(abs(words[s] - target[s]) <= 6 for s in target)
    # Of the rows that are alike, some take one copy more than others: the cut goes through them.
    assert len({r.copies for r in plan if r.size == 3 and r.source == "a"}) == 2


def test_no_task_gets_the_rows_without_ids(spark, make, monkeypatch):
    """The largest window group of the prefix sums stays near ROWS_PER_RANGE, though one id holds nearly all rows."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 20)
    keys = mixing.sized(many(make)).groupBy(*mixing.ALIKE).count().withColumn("_block", F.lit(0)).select(mixing.block_key().alias("k"))
    n = -(-keys.count() // 20)
    ranges = Counter(int(r.k[:8], 16) * n >> 32 for r in keys.collect())
    assert max(ranges.values()) < 60
