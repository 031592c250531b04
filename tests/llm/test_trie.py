"""The prefix trie against brute force, on odd tables, and its steps."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from graphquarry.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, family string, key string, first string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = turns.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        path = tuple(base[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    out = []
    for node, ms in members.items():
        below = [p for p in members if p[: len(node)] == node]
        inner = {p[:-1] for p in members if p}
        out.append((
            min(c for c, _ in ms), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(ms),
            sum(len(p) == len(node) + 1 for p in below), sum(p not in inner for p in below),
            sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below),
            hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in ms if end)).encode()).hexdigest(),
        ))
    return Counter(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = trie.build(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return Counter(map(tuple, got.collect()))


def some(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in [rng.choice([0, 100, 200, -100, 1700]) + rng.randrange(-40, 60) for _ in range(n)]:
        for t in range(rng.randrange(9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "héllo 😀", "", "ok"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_families(spark, seed):
    rows = some(seed) + [(100, t, "user", f"t{t}") for t in range(4)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 5, "user", "tie a"), (7, 5, "user", "tie b"),
        (0, 0, "u", "ab"), (0, 1, "ua", "b"), (199, 0, "u", None), (-5, 3, "u", "x"), (9_000_000_000_000_000_000, 0, "u", "big"), (7, None, None, "second"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()
    assert run(spark, [(None, 1, "a", "b")]) == Counter()


def test_copies_and_a_common_first_turn(spark):
    rows = []
    for c in range(0, 3000, 7):
        rows += [(c, t, "user", ["all begin so", "same" if c % 3 else f"own {c}", "end"][t]) for t in range(3)]
    assert run(spark, rows) == brute(rows)


def test_a_long_conversation(spark):
    """Thousands of turns take no more steps than few do: depth is no round of the plan."""
    rows = [(c, t, "user", f"turn {t}" if t < 2000 or c else "other") for c in (0, 1) for t in range(2500)]
    got = trie.build(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).collect()
    assert len(got) == 1 + 2000 + 2 * 500 and max(r.depth for r in got) == 2500
    root = next(r for r in got if r.depth == 0)
    assert (root.n_convs, root.n_children, root.n_leaves) == (2, 1, 2)
    assert root.saved_tokens == sum(len(f"turn {t}") for t in range(2000))


def test_ids_of_a_node_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 1)
    rows = [(c, 0, "user", "x") for c in range(0, 1000, 3)]
    assert run(spark, rows) == brute(rows)
