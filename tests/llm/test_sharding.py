"""Hash-tree sharding: the law, what moves, slots, odd tables."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphquarry.llm import sharding
from graphquarry.llm.sharding import Shard


def moved(spark, before, after, n=20_000):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"))
    both = sharding.assign(sharding.assign(df, F.col("k"), before, "a"), F.col("k"), after, "b")
    return Counter(map(tuple, both.select("a", "b").collect()))


def test_a_new_shard_takes_rows_only_into_itself(spark):
    tree = sharding.layout()
    for _ in range(3):
        pairs, tree = moved(spark, tree, sharding.grow(tree)), sharding.grow(tree)
        new = tree[-1].number
        assert all(a == b or b == new for a, b in pairs)
        share = sum(n for (a, b), n in pairs.items() if b == new) / 20_000
        assert abs(share - 1 / len(tree)) < 0.01


def test_weights_are_shares_and_confine_movement(spark):
    tree = tuple(Shard(s, s // 6, s // 2 % 3, 1.0 + s % 3) for s in range(12))
    heavier = tuple(Shard(s.number, s.region, s.rack, s.weight * (3 if s.number == 4 else 1)) for s in tree)
    pairs = moved(spark, tree, heavier)
    counts = Counter()
    for (a, _), n in pairs.items():
        counts[a] += n
    total = sum(s.weight for s in tree)
    for s in tree:
        assert abs(counts[s.number] / 20_000 - s.weight / total) < 0.012
    place = {s.number: (s.region, s.rack) for s in tree}
    for a, b in pairs:
        # Moves go into the heavier region, or within it into the heavier rack and shard; nothing moves elsewhere.
        if a != b:
            assert place[b][0] == 0
            if place[a][0] == 0:
                assert place[b] == place[4] and (place[a] != place[4] or b == 4)


def test_balance_and_uneven_layouts(spark):
    assert Counter((s.region, s.rack) for s in sharding.layout(7)) == {(0, 0): 2, (0, 1): 1, (0, 2): 1, (1, 0): 1, (1, 1): 1, (1, 2): 1}
    counts = Counter(a for (a, _), n in moved(spark, sharding.layout(), sharding.layout()).items() for _ in range(n))
    assert len(counts) == 24 and max(counts.values()) < 1.25 * min(counts.values())


def test_rows_and_slots(spark, edges, nothing, small):
    docs = edges.select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    got = sharding.place(docs).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d.doc_id, size(d.text), zlib.crc32((d.text or "").encode())) for d in docs.collect())
    slots, of_id = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(x) == 1 for x in of_id.values())
    assert sharding.place(nothing).collect() == []


def test_copies_are_numbered_in_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 7)
    docs = make([(1, "same")] * 100 + [(None, None)] * 50 + [(i, "x") for i in range(40)])
    slots = defaultdict(list)
    for r in sharding.place(docs).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 190
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
