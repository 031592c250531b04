"""The pipeline's near-dedup against all pairs of five-word shingle sets."""

import random

import corpus_pipeline

from graphquarry.llm import neardup, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_groups(texts):
    """Smallest index reachable over pairs of similarity 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, words, low, high):
    """words with some replaced until the similarity to the original is within low and high."""
    want = rng.uniform(low, high)
    out, base = list(words), shingles(" ".join(words))
    while jaccard(base, shingles(" ".join(out))) > want:
        last, out = out, list(out)
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(last)


def planted(seed=1, n=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(120, 400))]
        texts += [" ".join(words), edited(rng, words, 0.8, 0.95), edited(rng, words, 0.6, 0.75)]
    return texts


def test_edited_copies_go(spark, make):
    texts = planted()
    want = set(brute_groups(texts))
    assert len(want) <= 2 * len(texts) // 3  # the copies at 0.8-0.95 join, those below don't
    docs = make(list(enumerate(texts)))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    assert len(want) < simhash.near_dedup(docs).count()  # what three bits left in


def test_components_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    roots = brute_groups([r.text for r in rows])
    want = {rows[i].doc_id: rows[r].doc_id for i, r in enumerate(roots)}
    assert {r.doc_id: r.component_id for r in neardup.components(docs).collect()} == want


def test_a_large_group_meets_at_its_original(make):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)] + [edited(rng, words, 0.82, 0.9) for _ in range(150)]
    rng.shuffle(texts)
    got = neardup.components(make(list(enumerate(texts))), light=8).collect()
    assert set(brute_groups(texts)) == {0} == {r.component_id for r in got}


def test_links_that_no_hub_holds_are_found(make):
    """A chain of edits and several families in the same crowded buckets: exact groups, whatever the hub."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(200)]
    texts = []
    for f in range(6):  # families around a passage that all share: close to each other, but below 0.8
        words = shared + [f"f{f}w{i}" for i in range(40)]
        for _ in range(12):
            texts.append(edited(rng, words, 0.8, 0.9))
    for _ in range(15):  # each an edit of the one before
        shared = edited(rng, shared, 0.84, 0.86).split()
        texts.append(" ".join(shared))
    rng.shuffle(texts)
    want = brute_groups(texts)
    got = {r.doc_id: r.component_id for r in neardup.components(make(list(enumerate(texts))), light=4).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 3


def test_the_fingerprint_is_that_of_the_operator(spark):
    import xxhash

    text = " ".join(f"w{i}" for i in range(40))
    key, hashes = neardup.shingle_hashes(text)
    assert neardup.majority(hashes) == simhash.fingerprint(text, shingle=5) and key != 0


def test_odd_tables(edges, nothing):
    got = {r.doc_id: r.component_id for r in neardup.components(edges).where("doc_id IS NOT NULL").collect()}
    assert got[6] == 1 and got[2] == got[3] == got[4] == 2 and got[5] == 5
    out = neardup.near_dedup(edges)
    assert out.columns == edges.columns and out.where("doc_id IS NULL").count() == 2
    assert neardup.near_dedup(nothing).count() == 0
