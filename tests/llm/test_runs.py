"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphquarry.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every maximal stretch of every period, each kept with its smallest."""
    n, best = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def planted(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or n == 0 or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    w = planted(WORD.findall(text or ""), doc_id)
    found = brute(w)
    drop = {i for a, n, q in found for i in range(a + q, a + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    top = (None,) * 4
    if found:
        a, n, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        top = (a, n, q, 1000 * n // q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *top, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(kept)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 40)), max_size=4))
def test_runs_of_small_alphabets(noise, parts):
    s = [*noise, *(x for unit, times in parts for x in unit * times), *noise]
    assert runs.find_runs(np.array(s, np.int64)) == brute(s)


@pytest.mark.parametrize("seed", range(4))
def test_runs_at_the_bounds(seed):
    """Stretches one word below, at and above the bounds, with noise between them."""
    rng, s = random.Random(seed), []
    for _ in range(30):
        q = rng.choice([1, 2, 5, 7, 8, 9, 12, 20, 33])
        unit = [rng.randrange(6) for _ in range(q)]
        length = max(24, 3 * q) + rng.choice([-1, 0, 1, q])
        s += [unit[i % q] for i in range(length)] + [100 + rng.randrange(5) for _ in range(rng.randrange(3))]
    assert runs.find_runs(np.array(s, np.int64)) == brute(s)


@given(st.lists(st.integers(0, 2), max_size=60))
def test_z_function(s):
    a = np.array(s, np.int64)
    want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    assert runs.z_function(a).tolist() == want


def test_long_periodic_texts_take_near_linear_time():
    import time

    took = []
    for n in (40_000, 160_000):
        s = np.concatenate([np.arange(7) for _ in range(n // 7)] + [np.zeros(n // 2, np.int64), np.arange(50_000, 50_000 + n // 2)])
        began = time.process_time()
        found = runs.find_runs(s)
        took.append(time.process_time() - began)
        assert (0, n // 7 * 7 + 1, 7) in found and any(q == 1 for _, _, q in found)
    assert took[1] < 10 * took[0] + 1


def test_documents(spark, edges, small):
    docs = edges.select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    looped = spark.createDataFrame([(2000 + i, "head " + "a b c d e f g h i " * 9 + "tail " + "x " * 30) for i in range(40)], "doc_id long, text string")
    rows = [tuple(r) for r in docs.union(looped).collect()]
    got = runs.detect(spark.createDataFrame(rows, "doc_id long, text string"), planted=True, digests=True).collect()
    long = {r[1] for r in rows if len(r[1] or "") > 100_000}
    assert Counter(map(tuple, got)) == Counter(expected(*r) for r in rows if r[1] not in long) + Counter(tuple(x) for x in got if x.doc_id == 5)
    assert sum(r.n_runs > 0 for r in got) > 40
    assert any((r.doc_id or 0) < 2000 and r.n_runs for r in got)


def test_general_interface(spark, make, nothing):
    out = runs.detect(make([(1, "start " + "la lo " * 20 + "end")])).collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.collapsed) for r in out] == [(1, 1, 40, 2, "start la lo end")]
    assert out[0].runs == "1,40,2\n" and out[0].exponent_milli == 20_000
    assert runs.detect(nothing).collect() == []
