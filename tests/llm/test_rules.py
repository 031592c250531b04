"""Quality rules, mixing, line dedup: against brute force, and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

from conftest import LONG, EDGES  # noqa: F401
from pyspark.sql import functions as F

from graphquarry.llm import linedup, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def measured(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated)


def test_measurements(spark, edges, small):
    docs = edges.select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    got = quality.judge(docs).collect()
    pairs = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert pairs == Counter((r.doc_id, *measured(r.text)) for r in docs.collect())
    for r in got:
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == base and not (base and r.kept)


def test_policies_read_the_ledger(spark, make):
    docs = make([(1, "a b c"), (2, " ".join("abcdefghijklmnop")), (3, "x " * 40), (4, "*# " * 3)])
    book = quality.ledger(docs).cache()
    kept = {r.doc_id for r in quality.apply_policy(book, quality.BASE).where("kept").collect()}
    assert kept == {2}
    rows = {r.rule: r for r in quality.ablations(book, quality.BASE).collect()}
    assert rows["few_words"].n_fail == 2 and rows["few_words"].n_kept_without == 3
    assert rows["repeated_windows"].n_fail_alone == 1


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = judged.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()
    bad = judged.where("quality = 0")
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_keep_returns_the_rows(edges, nothing):
    out = quality.keep(edges)
    assert out.columns == edges.columns
    judged = quality.judge(edges).where("kept").select("doc_id").collect()
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in judged)
    assert quality.keep(nothing).count() == 0 and quality.judge(nothing).count() == 0


def mixed(rows, weights=(5.0, 2.0, 1.0), most=3):
    sizes = [(d, s, len(WORD.findall(t or ""))) for d, t, _, s in rows]
    total = defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(total.values())), set(names)
    while True:  # share, fix what is above its limit, share the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * total[s]}
        if not over:
            return total, target | share
        for s in over:
            target[s] = float(most * total[s])
            left -= target[s]
        free -= over


def test_mix(make, edges, nothing):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", "abcdefg"[i % 7] if i % 5 else "a") for i in range(300)] + [(1000, "w " * 4000, "en", "big"), (1001, "w", "en", None)]
    total, target = mixed(rows)
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for _, t, _, s in rows:
        largest[s] = max(largest[s], len(t.split()))
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix(make(rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(edges).count() == edges.count()
    assert mixing.mix(nothing).count() == 0 and mixing.take(nothing).count() == 0


def test_prefix_sums_over_many_ranges(spark, make, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("g").alias("g"), (F.col("id") % 9).alias("n"), mixing.mix_key("id").alias("k"))
    got = {r.doc_id: r.before for r in mixing.prefix_sums(rows, ["g"], "k", "n", ["doc_id"]).collect()}
    at = 0
    for r in sorted(rows.collect(), key=lambda r: r.k):
        assert got[r.doc_id] == at
        at += r.n


def test_take_repeats_documents(make):
    docs = make([(i, "w " * 10, "en", "a" if i < 4 else "b") for i in range(40)])
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: n for d, n in plan.items() if n})
    assert max(plan.values()) == 3


def deduped(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs, top = defaultdict(set), {}
    for i, (d, t, *_) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            docs[k].add(i)
            if d is not None and (top.get(k) is None or d > top[k]):
                top[k] = d
    gone = lambda d, k: len(k) >= 20 and len(docs[k]) >= 3 and d != top.get(k)
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not gone(d, key(x))]
        out[d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


def test_line_dedup(make, edges, nothing):
    line = "This Line is found in Many documents"
    rows = [(i, f"  {line.upper() if i % 2 else line}\t\nown line number {i} which is long\nshort") for i in range(9)]
    rows += [(100, f"{line}\n{line}\nx"), (101, "two of these are not enough, says the rule"), (102, "two of these are not enough, says the rule"), *EDGES]
    rows += [(200 + i, "Éa É line with accents, much longer than twenty\n") for i in range(3)] + [(300, "éa É line with accents, much longer than twenty")]
    got = linedup.dedup_lines(make(rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h")).collect()
    assert Counter(tuple(r) for r in got) == deduped(rows)
    assert linedup.dedup_lines(edges).count() == edges.count()
    assert linedup.dedup_lines(nothing).count() == 0


def test_runs_are_compacted_by_level(make):
    docs = make([(i, f"a line that is long enough to count {i % 3}") for i in range(30)])
    facts, decided, store = linedup.take_in(docs, batches=6, fanout=2)
    assert [len(x) for x in store.levels] == [0, 1, 1]
    state = [r for name in store.runs() for r in store.spark.table(name).collect()]
    total = Counter()
    for r in state:
        total[r.h1] += r.n_docs
    assert set(total.values()) == {10} and facts.count() == 30
    assert {r.h1 for r in decided.collect()} == set(total)
    store.close()
    assert store.runs() == []


def test_runs_are_joined_by_their_order(make):
    """The runs are neither shuffled nor sorted: the only exchange is that of the batch's own keys."""
    docs = make([(i, f"a line that is long enough to count {i % 3}\nand one more of these long lines {i}") for i in range(30)])
    facts, _, store = linedup.take_in(docs, batches=3)
    with linedup.sorted_buckets(store.spark):
        plan = store.met(facts)._jdf.queryExecution().executedPlan().toString()
        both = store._merged(*(2 * store.runs())[:2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == len(store.runs()) == 2
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan
    assert both.count("SortMergeJoin") == 1 and "Exchange" not in both and " Sort [" not in both
    store.close()


def test_every_batch_order_gives_the_same(make):
    """Keys that reach three documents early, late, or over many batches; largest holders that come last."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice((None, *range(-5, 60))), "\n".join(f"a shared line which is long enough, number {rng.choice((1, 2, 3, rng.randint(4, 40)))}" for _ in range(rng.randint(1, 6)))) for _ in range(120)]
    want = deduped(rows)
    for batches in (1, 2, 5, 9):
        got = linedup.dedup_lines(make(rows), batches=batches).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
        assert Counter(tuple(r) for r in got) == want


def test_documents_of_many_lines(make):
    """The time must not grow with the square of the lines of a document."""
    import time

    rows = [(i, "\n".join(f"line {k} is long enough to be counted" for k in range(16_000))) for i in range(3)]
    began = time.time()
    got = linedup.dedup_lines(make(rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert Counter(tuple(r) for r in got) == deduped(rows)
    assert time.time() - began < 25


def test_a_hot_line_takes_the_broadcast_way(make, monkeypatch):
    rows = [(i, f"the one line that all documents share\nown {i} own {i} own {i} own {i}") for i in range(50)]
    monkeypatch.setattr("graphquarry.llm.common.HOT_SHARE", 3)
    got = linedup.dedup_lines(make(rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert Counter(tuple(r) for r in got) == deduped(rows)
