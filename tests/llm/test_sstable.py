"""Token shards: round trips, lookups, and equality with whole-text encoding."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from conftest import EDGES
from tokenizers import Tokenizer

from graphquarry.llm import sstable
from graphquarry.llm.common import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


TEXTS = [
    "a  b", "\n x", "a ", " lead", "don't stop, it's fine's", "x² y² ½", "a\n\nb", "été, naïve… «ok»", "tab\there", "a_b c_d 12a", "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>\ny <|endoftext|>", "a <|ENDOFTEXT|> b",
    "e\u0301a b", "日本 語", "😀 👍🏽", "\u00a0x y", "A", "a ?! b", "Ünï\ncode line\nnext", "\x85 x", "a\x1cb c", "ſ K", "o'clock ' s", "x" * 3000, " ", "\n",
]


@pytest.mark.parametrize("most", [300_000, 0])
def test_pieces_equal_whole_texts(tokenizer, most, spark, small):
    enc = sstable.Encoder(PATH, most=most)
    assert enc.byte_level
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == ids_of(tokenizer, t), t


def test_random_texts(tokenizer):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = sstable.Encoder(PATH)
    letters = st.sampled_from(["<|endoftext|>"] + list("abE éß'’.,!?-_0129 \n\t\u00a0日²½😀") + [" ", " ", "'s", " the"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(letters, max_size=24).map("".join))
    def check(t):
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == ids_of(tokenizer, t)

    check()


def test_special_strings_have_their_ids(tokenizer):
    enc = sstable.Encoder(PATH)
    assert np.frombuffer(enc.encode("a <|endoftext|> b"), "<u2").tolist() == [64, 220, 50256, 275, 2]


def test_long_pieces_are_not_kept():
    enc = sstable.Encoder(PATH)
    enc.encode("word " + "q7Zx" * 50_000 + " word")
    assert max(map(len, enc.cache)) <= sstable.CACHE_CHARS + 1


def test_another_kind_of_model():
    """A vocabulary that isn't byte-level is encoded whole, piece by piece only where that is the same."""
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, t = sstable.Encoder(path), Tokenizer.from_file(path)
    assert not enc.byte_level
    for text in ("Hello World again", "été naïve"):
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids + [2]


def test_store(edges, tokenizer, nothing):
    rows = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(sstable.store(edges, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    one = lambda t: (len(x := ids_of(tokenizer, t)), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, *one(t)) for d, t, *_ in EDGES)
    assert sstable.store(nothing, PATH).count() == 0


def test_lookup(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 3_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = new_folder(spark, "shards")
    manifest = sstable.write_shards(docs.where("doc_id % 2 = 0"), PATH, folder, shard_bytes=60_000).cache()
    assert manifest.count() > 8
    texts = {r.doc_id: r.text for r in docs.where("doc_id IN (0, 14, 500, 998)").collect()}
    found = sstable.lookup(spark, manifest, folder, [*texts, 7, 10**9, None])
    for d, t in texts.items():
        (ids,) = found[d]
        assert ids.tolist() == ids_of(tokenizer, t)
    assert found[7] == found[10**9] == found[None] == []
    fs, _ = pafs.FileSystem.from_uri(folder)
    shard = sstable.Shard.open(fs, manifest.orderBy("shard", "part").first().path)
    index = shard.index()
    assert len(index) > 1 and [k for k, *_ in index] == sorted(k for k, *_ in index)
    keys = [k for k, _, _ in shard.scan()]
    assert len(keys) == shard.records and keys == sorted(keys)


def test_keys_keep_their_order():
    ids = [None, -(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids
