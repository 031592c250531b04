"""Benchmark decontamination against brute force."""

import re
from collections import Counter

import pytest
from conftest import EDGES

from graphquarry.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, window=10):
    windows = {}
    for name, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + window]), set()).add(str(name) if name is not None else "")
    out = Counter()
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        out[d, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())


PASSAGE = "Alpha beta, gamma delta: epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [
    (1, PASSAGE),
    (10, "short One"),
    (2, "Überall straße and ñandú"),
    (3, None),
    (4, " .,; "),
    (None, "nameless item of six whole words"),
    (1, "the same item again with another text that has ten words and more"),
    (7, "a a a a a a a a a a a a"),
]
DOCS = [
    (1, f"before {PASSAGE.upper()} after"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (4, "SHORT--one and short two; short, one"),
    (5, "überall Straße AND ñandú"),
    (6, "nameless item of six whole words the same item again with another text that has ten words and"),
    (7, "a " * 25),
    (8, "short"),
    (8, "one short one"),
    (9, f"{PASSAGE} {PASSAGE} short one"),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_words", [500_000, 5])
def test_against_brute_force(make, items, block_words):
    rows = DOCS + [(100 + (d or 0), t) for d, t, *_ in EDGES] + [(200, " ".join((EDGES[4][1], PASSAGE, EDGES[4][1])))]
    assert found(decontaminate.find(make(rows), items, block_words=block_words)) == brute(rows, ITEMS)


def test_on_test_documents(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    rows, known = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    assert found(decontaminate.find(docs, items)) == brute(rows, known)


def test_candidates_are_taken_in_slices(make, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 50)
    assert found(decontaminate.find(make(DOCS), items)) == brute(DOCS, ITEMS)


def test_clean_drops_what_is_hit(make, items, edges, nothing, spark):
    out = decontaminate.clean(make(DOCS), items)
    assert {r.doc_id for r in out.collect()} == {2, 5, 8} and out.count() == 3 and out.columns == make(DOCS).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(edges, none).count() == edges.count()
    assert decontaminate.find(nothing, items).count() == 0


def test_a_share_below_one(make, spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = make([(1, "x a b c d e f g h i z y"), (2, "a b c d e x g h i j"), (3, "a b c d e f g h i j")])
    hit = {r.doc_id for r in decontaminate.find(docs, items, shingle=3, share=0.8).where("n_hit > 0").collect()}
    assert hit == {1, 3}


def test_prefix_shingles_are_the_rarest(spark):
    block = decontaminate.build_block([("1", words("a b c d e f g h i j"))], 10, 5, 1.0)
    (h,) = [decontaminate.rolling(block.ids, 5)[1]]
    counts = {(5, int(x)): 9 for x in h} | {(5, int(h[3])): 1}
    decontaminate.rank(block, counts, 5)
    assert block.shingles[5].tolist() == [int(h[3])] and block.places[5][2].tolist() == [3]
