"""SimHash near-dedup against all pairs."""

import random
from collections import Counter

import pytest
import xxhash
from conftest import EDGES
from pyspark.sql import functions as F

from graphquarry.llm import simhash

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    """Smallest index reachable, for a list of fingerprints."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints(edges):
    got = Counter((r.doc_id, r.fingerprint) for r in simhash.fingerprints(edges).select("doc_id", simhash.as_hex().alias("fingerprint")).collect())
    assert got == Counter((d, f"{brute_fingerprint(t):016x}") for d, t, *_ in EDGES)


def test_components_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    ids = [r.doc_id for r in rows]
    roots = brute_components([brute_fingerprint(r.text) for r in rows])
    want = {ids[i]: ids[r] for i, r in enumerate(roots)}
    assert {r.doc_id: r.component_id for r in simhash.components(docs).collect()} == want
    stay = simhash.near_dedup(docs)
    assert {r.doc_id for r in stay.collect()} == set(want.values()) and stay.columns == docs.columns


def near_fingerprints(seed, groups=12, size=30):
    """Clusters around random centres, with chains that only single links hold together."""
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            if rng.random() < 0.5:
                x = y
            out.add(y)
    return sorted(out)


@pytest.mark.parametrize("light", [64, 2])
def test_links_keep_the_components(spark, light):
    """With light = 2 nearly all buckets go the way of large ones."""
    fps = near_fingerprints(light)
    reps = spark.createDataFrame([(simhash.signed(x), i, 1) for i, x in enumerate(fps)], "fp long, first long, n_docs long")
    edges = simhash.links(reps, len(fps), light=light)
    for r in edges.collect():
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3
    tree = {r.node: r.root for r in simhash.connected(edges).collect()}
    label = [tree.get(simhash.signed(x), simhash.signed(x)) for x in fps]
    groups = brute_components(fps)
    assert len(set(zip(label, groups))) == len(set(label)) == len(set(groups))


def coordinates(x, masks):
    references = [p % 2**64 for p in simhash.bases()]
    references += [p ^ m for m in masks for p in references[: simhash.BASES]]
    return [(x ^ p).bit_count() for p in references]


def test_pivots_bring_all_links_together(spark):
    """Each link shares a bucket that the distances alone define, and no coordinate of it differs by more than three."""
    rng = random.Random(7)
    for n in (10, 10**7, 10**9):
        masks = simhash.blocks(n)
        assert sum(masks) == 2**64 - 1
        pairs = [(x := rng.getrandbits(64), x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))) for _ in range(60)]
        reps = spark.createDataFrame([(simhash.signed(x),) for pair in pairs for x in pair], "fp long")
        keys, pivots = {}, {}
        for r in simhash.bucketed(simhash.pivot_table(reps, masks), masks).collect():
            keys.setdefault(r.fp % 2**64, set()).add((r.mask, r.key))
            pivots[r.fp % 2**64] = r.pivots
        for a, b in pairs:
            assert keys[a] & keys[b]
            assert pivots[a] == coordinates(a, masks) and max(abs(x - y) for x, y in zip(pivots[a], pivots[b])) <= 3
    assert len(simhash.blocks(10**9)) > len(simhash.blocks(10))


def test_without_the_distances_there_are_no_candidates(spark):
    """Fingerprints whose pivot coordinates are made unlike meet nobody."""
    masks = simhash.blocks(10)
    reps = spark.createDataFrame([(5,), (7,)], "fp long")
    table = simhash.pivot_table(reps, masks)
    shifted = table.withColumn("pivots", F.transform("pivots", lambda x, i: F.when(i < simhash.BASES, x + F.col("fp").cast("tinyint")).otherwise(x)))
    meets = lambda t: simhash.bucketed(t, masks).groupBy("mask", "key").count().where("count > 1").count()
    assert meets(table) > 0 == meets(shifted)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 101


def test_odd_tables(edges, nothing):
    got = simhash.components(edges)
    assert got.count() == edges.count()
    found = {r.doc_id: r.component_id for r in got.where("doc_id IS NOT NULL").collect()}
    assert found[6] == 1 and found[3] == found[4] == found[2] == 2
    out = simhash.near_dedup(edges)
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[1] == 1 and ids[6] == 0 and ids[2] == 1 and ids[None] == 2
    assert simhash.components(nothing).count() == 0 and simhash.near_dedup(nothing).count() == 0


def test_exact_copies_meet_in_one_fingerprint(make):
    docs = make([(i, "the same text for all of these documents, word for word") for i in range(40, 0, -1)])
    assert simhash.components(docs).select(F.min("component_id"), F.max("component_id")).first() == (1, 1)
