"""The pipeline against a brute-force version of each stage, and the registered queries."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import CLASHES
from test_decontaminate import brute as brute_hits
from test_neardup import brute_groups
from test_rules import measured
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from graphquarry.llm import mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage returns for the test documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mix_sources", "token_shards"]
    for df in steps[:-1]:
        assert df.columns == docs.columns

    kept = {r.doc_id for r in steps[0].collect()}
    for r in docs.collect():
        n, _, _, _, repeated = measured(r.text)
        if n < 10 or 100 * repeated > 20 * n:
            assert r.doc_id not in kept
    assert ids(steps[0]) == Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())

    rows = sorted(steps[0].collect(), key=lambda r: r.doc_id)
    roots = brute_groups([r.text for r in rows])
    assert ids(steps[1]) == Counter(rows[i].doc_id for i in set(roots))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in steps[1].collect()], items)
    assert ids(steps[2]) == Counter(d for d, _, n, _ in hits if n == 0)

    plan = mixing.mix(steps[2]).collect()
    assert ids(steps[3]) == Counter({r.doc_id: r.copies for r in plan if r.copies})

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, Counter()
    for r in sorted(steps[3].collect(), key=lambda r: r.doc_id):
        x = tok.encode(r.text, add_special_tokens=False).ids + [2]
        want[r.doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
        at += len(x)
    assert Counter(tuple(r) for r in steps[4].collect()) == want


def test_run_is_its_stages(spark, steps):
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == Counter(tuple(r) for r in steps[-1].collect())


def test_stages_on_odd_tables(spark, edges, nothing):
    for docs in (edges, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "token_shards":
                assert docs.columns == columns
        docs.collect()


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names and CLASHES
