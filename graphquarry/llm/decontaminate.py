"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of WINDOW consecutive words, and a window into shingles. A window needs
`share` of its shingles to occur (1 for an exact occurrence), so it must lose its match if none of its
first S - ceil(share * S) + 1 shingles in any fixed order occurs: with the rarest first, only these prefix
shingles are looked up. Rarity is each shingle's number of occurrences in all documents. A prefix shingle at
word p of a document, which stands at place o of a window, puts the window at p - o: it has to lie within
the document (length and position), and only then are its words compared.

The items, a stated query set, are taken in blocks of a bounded number of words, and a block's index is broadcast. Documents are
read twice, once for the rarity of shingles and once for the windows; each time a text is cut into words once and passes
all blocks in the task that reads it, so documents are never shuffled. The blocks together must fit in a worker:
about a hundred bytes for each word of the benchmark.

Defined cases: null, empty and wordless texts have no words and no hits; an item without words is in no document; items
that share an item_id count once; a null item_id counts as an item named by the empty string; an
empty benchmark leaves all documents clean; further columns of docs are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm.common import quoted

WINDOW = 10
SHINGLE = 5
#: Words of the items in one broadcast block; a block has one item at least.
BLOCK_WORDS = 500_000
CHUNK_BYTES = 1_000_000
CANDIDATES = 200_000

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: all other ASCII turns into spaces.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def rolling(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which `width` known words stand together, and their hashes."""
    if len(ids) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    m = len(ids) - width + 1
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    at = np.flatnonzero(unknown[width:] == unknown[:m])
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h = (h + ids[at + j].astype(np.uint64) + np.uint64(1)) * MULT
        h ^= h >> np.uint64(29)
    return at, h


@dataclass
class Block:
    """The index of some items. Windows are (start in ids, length, item); shingles have width min(SHINGLE, length)."""

    vocab: dict[bytes, int]
    items: list[str]
    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    #: width -> sorted hashes of the shingles of windows of that width; after rank(): of the prefix shingles
    shingles: dict[int, np.ndarray]
    #: width -> (first entry of each hash, window of each entry, place in the window)
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    share: float


def build_block(items: list[tuple[str, list[bytes]]], window: int, shingle: int, share: float) -> Block:
    vocab: dict[bytes, int] = {}
    ids, start, length, item = [], [], [], []
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    seen = set()
    for name, words in items:
        own = [vocab.setdefault(w, len(vocab)) for w in words]
        base = len(ids)
        ids += own
        for s in range(max(1, len(own) - window + 1)):
            key = (number[name], tuple(own[s : s + window]))
            if key not in seen:
                seen.add(key)
                start.append(base + s), length.append(min(window, len(own))), item.append(number[name])
    block = Block(vocab, names, np.array(ids, np.int64), *(np.array(x, np.int64) for x in (start, length, item)), {}, {}, share)
    for width in sorted({min(shingle, n) for n in length}):
        _, h = rolling(block.ids, width)
        block.shingles[width] = np.unique(h)
    return block


def rank(block: Block, counts: dict[tuple[int, int], int], shingle: int) -> None:
    """Leaves in the index only the prefix shingles of each window: the rarest, as many as it needs."""
    found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for w, (s, n) in enumerate(zip(block.start.tolist(), block.length.tolist())):
        width = min(shingle, n)
        _, h = rolling(block.ids[s : s + n], width)
        order = sorted(range(len(h)), key=lambda i: (counts.get((width, int(h[i])), 0), int(h[i]), i))
        for o in order[: len(h) - ceil(block.share * len(h)) + 1]:
            found[width][int(h[o])].append((w, o))
    block.shingles, block.places = {}, {}
    for width, at in found.items():
        keys = sorted(at)
        flat = [x for k in keys for x in at[k]]
        block.shingles[width] = np.array(keys, np.uint64)
        block.places[width] = (
            np.cumsum([0] + [len(at[k]) for k in keys]),
            np.array([w for w, _ in flat], np.int64),
            np.array([o for _, o in flat], np.int64),
        )


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row), about CHUNK_BYTES of text at a time."""
    first, size, rows = 0, 0, []
    for i, t in enumerate(texts):
        rows.append(words_of(t))
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield first, rows
            first, size, rows = i + 1, 0, []
    if rows:
        yield first, rows


def known_ids(rows: list[list[bytes]], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words with an unknown word after each row, and where each row starts."""
    get, ids = vocab.get, []
    for words in rows:
        ids += [get(w, -1) for w in words]
        ids.append(-1)
    starts = np.cumsum([0] + [len(w) + 1 for w in rows])
    return np.array(ids, np.int64), starts


def lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are among the sorted keys, and their places there."""
    if not len(keys) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[k] == h)
    return hit, k[hit]


def tally(texts: list[str | None], blocks: list[Block]) -> list[dict[int, np.ndarray]]:
    """Occurrences of each shingle of each block."""
    out = [{w: np.zeros(len(k), np.int64) for w, k in block.shingles.items()} for block in blocks]
    for _, rows in chunks(texts):
        for block, counts in zip(blocks, out):
            ids, _ = known_ids(rows, block.vocab)
            for width, keys in block.shingles.items():
                _, h = rolling(ids, width)
                _, k = lookup(keys, h)
                counts[width] += np.bincount(k, minlength=len(keys))
    return out


def holds(ids: np.ndarray, at: np.ndarray, block: Block, w: np.ndarray, width: int, share: float) -> np.ndarray:
    """Whether window w occurs at each position: enough of its shingles stand where it has them."""
    n = int(block.length[w[0]])
    equal = ids[at[:, None] + np.arange(n)] == block.ids[block.start[w][:, None] + np.arange(n)]
    sums = np.concatenate([np.zeros((len(at), 1), np.int64), np.cumsum(equal, 1)], 1)
    whole = (sums[:, width:] - sums[:, :-width] == width).sum(1)
    return whole >= ceil(share * (n - width + 1))


def occurrences(rows: list[list[bytes]], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, window) of all verified windows, with positions over the words of all rows and their ends."""
    ids, starts = known_ids(rows, block.vocab)
    row_of = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    out = [(np.empty(0, np.int64),) * 3]
    for width, keys in block.shingles.items():
        at, h = rolling(ids, width)
        hit, k = lookup(keys, h)
        first, windows, offsets = block.places[width]
        many = first[k + 1] - first[k]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(k):  # a bounded number of candidates at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, "right")))
            m = many[lo:hi]
            entry = np.repeat(first[k[lo:hi]], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
            p, w = np.repeat(at[hit[lo:hi]], m), windows[entry]
            s, n = p - offsets[entry], block.length[w]
            row = row_of[p]
            fits = (s >= starts[row]) & (s + n <= starts[row + 1] - 1)
            s, n, w = s[fits], n[fits], w[fits]
            for size in np.unique(n):
                own = np.flatnonzero(n == size)
                ok = own[holds(ids, s[own], block, w[own], width, block.share)]
                out.append((s[ok], n[ok], w[ok]))
            lo = hi
    return tuple(np.concatenate(x) for x in zip(*out))


def scan(texts: list[str | None], blocks: list[Block]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """For each text: words, merged hit spans (first word, end, first word, end ...) and items."""
    n_words, spans, items = [], [], []
    for _, rows in chunks(texts):
        starts = np.cumsum([0] + [len(r) + 1 for r in rows])
        edge = np.zeros(starts[-1] + 1, np.int64)
        own: dict[int, set[str]] = defaultdict(set)
        for block in blocks:
            s, n, w = occurrences(rows, block)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + n, -1)
            row = np.searchsorted(starts, s, "right") - 1
            for r, i in set(zip(row.tolist(), block.item[w].tolist())):
                own[r].add(block.items[i])
        inside = (np.cumsum(edge) > 0).astype(np.int8)
        step = np.flatnonzero(np.diff(np.concatenate([[0], inside]))).tolist()
        j = 0
        for r, words in enumerate(rows):
            mine: list[int] = []
            while j < len(step) and step[j] < starts[r + 1]:
                mine.append(step[j] - int(starts[r]))
                j += 1
            n_words.append(len(words)), spans.append(mine), items.append(sorted(own.get(r, ())))
    return n_words, spans, items


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, streamed to the driver one block of at most block_words (or one item) at a time."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").orderBy("name", "text")
    size, out = 0, []
    for r in rows.toLocalIterator():
        if words := words_of(r["text"]):
            if out and size + len(words) > block_words:
                yield out
                size, out = 0, []
            out.append((r["name"], words))
            size += len(words)
    if out:
        yield out


def mark(
    docs: DataFrame,
    items: DataFrame,
    keep: tuple[str, ...],
    window: int = WINDOW,
    shingle: int = SHINGLE,
    share: float = 1.0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """_doc (the kept columns of docs as one struct, so that none can clash), _n_words, _spans, _items and _n_hit."""
    sc = docs.sparkSession.sparkContext
    blocks = [build_block(own, window, shingle, share) for own in item_blocks(items, block_words)]
    if blocks:
        counts = _counts(docs.select("text"), [sc.broadcast(vars(b)) for b in blocks])
        for b, own in zip(blocks, counts):
            rank(b, own, shingle)
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("_doc"), F.col("text").alias("_text"))
    out = _found(packed, [sc.broadcast(vars(b)) for b in blocks])
    hit = F.aggregate(
        F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, b: a + b
    )
    return out.withColumn("_n_hit", hit)


def find(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, spans (merged hits: first word, end, first word, end ...), items (sorted) and n_hit."""
    found = mark(docs, items, ("doc_id",), **how)
    return found.select("_doc.doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "spans", "items", "n_hit")])


def _counts(texts: DataFrame, blocks: list) -> list[dict[tuple[int, int], int]]:
    """Occurrences of the blocks' shingles in all documents, in one pass; as many rows as they have shingles at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Block(**b.value) for b in blocks]
        total: list[dict[int, np.ndarray]] = [{} for _ in own]
        for b in batches:
            for sums, counts in zip(total, tally(b.column(0).to_pylist(), own)):
                for width, n in counts.items():
                    sums[width] = sums[width] + n if width in sums else n
        for k, sums in enumerate(total):
            for width, n in sums.items():
                at = np.flatnonzero(n)
                h = own[k].shingles[width][at].view(np.int64)
                yield pa.RecordBatch.from_pydict({"block": np.full(len(at), k, np.int32), "width": np.full(len(at), width, np.int32), "h": h, "n": n[at]})

    rows = texts.mapInArrow(run, "block int, width int, h long, n long").groupBy("block", "width", "h").agg(F.sum("n").alias("n"))
    out: list[dict[tuple[int, int], int]] = [{} for _ in blocks]
    for r in rows.collect():
        out[r["block"]][r["width"], r["h"] % (1 << 64)] = r["n"]
    return out


FOUND = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_spans", T.ArrayType(T.LongType())),
    T.StructField("_items", T.ArrayType(T.StringType())),
]


def _found(docs: DataFrame, blocks: list) -> DataFrame:
    """_doc with what was found in _text, in one pass over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Block(**b.value) for b in blocks]
        for b in batches:
            n_words, spans, items = scan(b.column("_text").to_pylist(), own)
            columns = [b.column("_doc"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_doc", *[f.name for f in FOUND]])

    return docs.mapInArrow(run, T.StructType([docs.schema["_doc"], *FOUND]))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no window of any item."""
    return mark(docs, items, tuple(docs.columns), **how).where("_n_hit = 0").select("_doc.*")
