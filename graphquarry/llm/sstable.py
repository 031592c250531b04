"""Token-ID output as sorted-string-table shards.

A shard is one binary file. Its records are keyed by document and ascend by key:

    block*  zstd( record* ), record = varint shared, varint rest, varint value length, key rest, value
    index   for each block: its last key, where it starts, its length and the ids before it
    bloom   a Bloom filter over the shard's keys
    footer  fixed size: places of index and bloom, records, ids, id width, checksum, MAGIC

A key is a flag byte (0: null id) and the id as 8 big-endian bytes with the sign flipped, so that byte order is
number order; a record stores only what its key does not share with the key before it in the block. Values are the
document's ids, end id included, as little-endian 16- or 32-bit integers. lookup() reads a footer, asks the
Bloom filter, finds the block by binary search in the index and reads that block only.

Texts are dealt by ranges of doc_id and sorted within, so shards ascend too. A task writes its shards under names
of its own attempt, and only the manifest, which Spark commits for one attempt of each task, names the shards that
count: what a lost or speculative attempt leaves behind is never read. The driver sees one manifest row a shard.
Strings of the vocabulary's special tokens become their ids, as the library does by default.

Defined cases: a null or empty text is the end id alone; null ids come first and are found by lookup of None; rows that repeat
a doc_id are all kept, in the order of the hash of their text; texts of any length are encoded whole, by pieces; an empty table
gives no shard and an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.llm.common import new_folder

END_ID = 2
BLOCK_BYTES = 64_000
SHARD_BYTES = 64_000_000
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"GQSST001"
FOOTER = "<QQQQQQBI8s"
#: Pieces that a worker remembers, and the longest of them in characters: together they bound its memory.
CACHE_PIECES = 600_000
CACHE_CHARS = 32

# Where a single space stands between other characters, a byte-level BPE's pre-tokens always break before it,
# so a text of words between single spaces is the sum of its pieces. Other texts are encoded in one.
ODD_PAIRS = ("  ", " \n", "\n ", "\n\n")
ODD_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# A pre-token of Latin letters, and one of signs behind it: they break apart there, too.
WORD_SIGNS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([^\w\s']*)")
PROBES = (" the", "and", " \u00e9t\u00e9", " verst\u00e4ndlich", "A")


def byte_letters() -> list[str]:
    """The printable letter for each byte in a byte-level vocabulary: itself, or the next one above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def of_worker(path: str) -> tuple:
    """The tokenizer and the pieces known so far, kept for the life of the worker process.

    This module travels to the workers by value, anew for each task, so its own globals don't last; a module of
    the process's own does.
    """
    import tokenizers

    held = vars(sys.modules.setdefault("graphquarry_worker", types.ModuleType("graphquarry_worker")))
    if path not in held:
        held[path] = tokenizers.Tokenizer.from_file(path), {}
    return held[path]


class Encoder:
    """Texts to little-endian ids. Pieces seen first, which the frequent ones are, stay known, up to a bound."""

    def __init__(self, path: str, end_id: int = END_ID, most: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
        self.tok, self.cache = of_worker(path)
        special = sorted(t.content for t in self.tok.get_added_tokens_decoder().values() if t.content)
        #: A text that holds one is left to the library whole.
        self.special = re.compile("|".join(map(re.escape, special)), re.I) if special else None
        self.width = 2 if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.end = self._bytes([end_id])
        self.most = most
        self.newline = self._whole("\n")
        self.letters, self.model = byte_letters(), self.tok.model
        try:
            self.byte_level = all(self._word(p) == self._whole(p) for p in PROBES)
        except Exception:  # another kind of model may not know these letters
            self.byte_level = False

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()  # little-endian on every machine that Spark runs on here

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _word(self, word: str) -> bytes:
        """A single pre-token, straight through the library's model."""
        letters = self.letters
        return self._bytes([t.id for t in self.model.tokenize("".join([letters[b] for b in word.encode()]))])

    def _spaced(self, piece: str) -> bytes:
        """The ids of a piece behind its space. Its lines break apart, and so do a word and the signs behind it."""
        if not self.byte_level:
            out = self._whole(" " + piece)
        elif piece.isascii() and piece.isalpha():
            out = array(self.code, [t.id for t in self.model.tokenize(self.letters[32] + piece)]).tobytes()
        elif "\n" in piece:
            first, *rest = piece.split("\n")
            lines = [self.cache.get(first) or self._spaced(first)]
            for line in rest:
                lines += (self.newline, self._bare(line))
            return b"".join(lines)
        elif (m := WORD_SIGNS.fullmatch(piece)) is None:
            out = self._whole(" " + piece)
        elif m[2]:
            out = (self.cache.get(m[1]) or self._spaced(m[1])) + self._bare(m[2])
        else:
            out = self._word(" " + piece)
        if len(self.cache) < self.most and len(piece) <= CACHE_CHARS:
            self.cache[piece] = out
        return out

    def _bare(self, piece: str) -> bytes:
        """The ids of a piece with no space before it; kept under a key that no other piece has."""
        if not piece:
            return b""
        key = "\n" + piece
        if (out := self.cache.get(key)) is None:
            m = WORD_SIGNS.fullmatch(piece) if self.byte_level else None
            if m is None:
                out = self._whole(piece)
            else:
                out = self._word(m[1]) + (self._bare(m[2]) if m[2] else b"")
            if len(self.cache) < self.most and len(piece) <= CACHE_CHARS:
                self.cache[key] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.special and self.special.search(text):
            return self._whole(text) + self.end
        odd = text[0].isspace() or text[-1] == " " or any(x in text for x in ODD_PAIRS) or any(x in text for x in ODD_SPACES)
        if odd:
            return self._whole(text) + self.end
        first, *rest = text.split(" ")
        head = self._whole(first) if "\n" in first else self._bare(first)
        get, spaced = self.cache.get, self._spaced
        return head + b"".join([get(p) or spaced(p) for p in rest]) + self.end


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b) % (1 << 64) % size for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, path: str = ""):
        self.out, self.width, self.path = out, width, path
        self.at = self.records = self.ids = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.crc = 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self) -> None:
        self.block, self.size, self.last, self.before = [], 0, b"", self.ids

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        head = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += [head, value]
        self.size += len(head) + len(value)
        self.last = key
        self.records += 1
        self.ids += len(value) // self.width
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zstd.compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(data), self.before))
            self._put(data)
            self._start()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        for key, at, size, before in self.index:
            self._put(varint(len(key)) + key + varint(at) + varint(size) + varint(before))
        bloom = np.zeros(max(64, len(self.keys) * BLOOM_BITS), np.uint8)
        for key in self.keys:
            bloom[bloom_places(key, len(bloom))] = 1
        bloom_at = self.at
        self._put(np.packbits(bloom).tobytes())
        self.out.write(struct.pack(FOOTER, index_at, bloom_at, self.at - bloom_at, len(bloom), self.records, self.ids, self.width, self.crc, MAGIC))


@dataclass
class Shard:
    """An open shard: only its footer is read at first."""

    file: object
    index_at: int
    bloom_at: int
    bloom_size: int
    bloom_bits: int
    records: int
    ids: int
    width: int
    crc: int

    @classmethod
    def open(cls, fs: pafs.FileSystem, path: str) -> Shard:
        file, size = fs.open_input_file(path), struct.calcsize(FOOTER)
        *places, magic = struct.unpack(FOOTER, file.read_at(size, file.size() - size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        return cls(file, *places)

    def index(self) -> list[tuple[bytes, int, int, int]]:
        data, at, out = self.file.read_at(self.bloom_at - self.index_at, self.index_at), 0, []
        while at < len(data):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            start, at = read_varint(data, at)
            size, at = read_varint(data, at)
            before, at = read_varint(data, at)
            out.append((key, start, size, before))
        return out

    def block(self, start: int, size: int) -> Iterator[tuple[bytes, bytes]]:
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, start))
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        """key, ids before it in the shard, value; one block in memory at a time."""
        for _, start, size, before in self.index():
            for key, value in self.block(start, size):
                yield key, before, value
                before += len(value) // self.width

    def lookup(self, key: bytes) -> list[bytes]:
        bloom = self.file.read_at(self.bloom_size, self.bloom_at)
        if not all(bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(key, self.bloom_bits)):
            return []
        index, out = self.index(), []
        for last, start, size, _ in index[bisect_left(index, key, key=lambda x: x[0]) :]:
            out += [v for k, v in self.block(start, size) if k == key]
            if last > key:
                break
        return out


MANIFEST = "shard int, part int, path string, n_docs long, n_ids long, first_key binary, last_key binary"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of docs into folder and returns their manifest, read back from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer, end_id)
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt, n, w = task.partitionId(), task.taskAttemptId(), 0, None
        rows = []

        def close() -> None:
            w.close()
            w.out.close()
            rows.append((part, n, w.path, w.records, w.ids, w.keys[0], w.keys[-1]))

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                if w is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/shard-{part:06d}-{n:04d}-{attempt}.sst"
                    w = ShardWriter(fs.open_output_stream(path), enc.width, path)
                w.add(key_of(doc_id.as_py()), enc.encode(text.as_py()))
                if w.at >= shard_bytes:
                    close()
                    n, w = n + 1, None
        if w is not None:
            close()
        names = ["shard", "part", "path", "n_docs", "n_ids", "first_key", "last_key"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    tie = F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("_tie")).repartitionByRange("doc_id", "_tie")
    sorted_ = dealt.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    sorted_.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids, from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard.open(fs, path)
                rows, size = [], 0
                for key, before, value in shard.scan():
                    ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4").tobytes()
                    rows.append((id_of(key), base + before, len(ids) // 4, zlib.crc32(ids), value))
                    size += len(value)
                    if size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        )

    # One row a shard, each tens of MB of ids: a window over the manifest is a small one.
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long").alias("base"))
    spread = based.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(spark: SparkSession, manifest: DataFrame, folder: str, doc_ids: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids of some documents, read on the driver from the shards whose key range holds them."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    out: dict[int | None, list[np.ndarray]] = {}
    for d in doc_ids:
        key = key_of(d)
        at = manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("shard", "part")
        out[d] = []
        for r in at.select("path").collect():
            shard = Shard.open(fs, r["path"])
            out[d] += [np.frombuffer(v, f"<u{shard.width}") for v in shard.lookup(key)]
    return out


def store(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to shards in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, tokenizer, folder, end_id), folder).drop("ids")
