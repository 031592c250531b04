"""SimHash near-dedup for corpora: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of the SimHash operator (A-Z folded, split at ASCII white space); a text of fewer than five words is one
shingle. Texts equal after that folding meet in one key first. The pivot tables of the SimHash operator find
pairs of texts whose five-word fingerprints differ in three bits or fewer. At a similarity of 0.8 two fingerprints differ in ten
bits on average, though, where no pivot discards much, so further candidates are texts that agree on all ROWS
min-hashes of one of BANDS bands: a pair of similarity 0.8 is one with probability 1 - (1 - 0.8 ** 4) ** 20 = 0.99997, more
similar ones still surer. Each candidate pair is verified on the whole shingle sets, and components join the verified links.

The members of a bucket of more than LIGHT texts are not paired with each other. First each is tried against the
bucket's hub, the member that shares its buckets with most texts (the original, where a bucket holds edits of one). Then all
texts of such buckets go through an exact prefix-filtered join: of a text's shingles, ordered by how few of these texts hold them,
similar texts share one of the first n - ceil(0.8 n) + 1. Only texts that aren't connected yet are paired by it, and only if
the shingles from the shared one on can add up to the similarity. So a group of
thousands of copies of one text costs no pair, texts that share a passage cost none, and no link is lost. What it
does pair are unconnected texts that differ in few shingles each and still fall below 0.8: their pairs grow with the square of their number.

Defined cases: null, empty and wordless texts are copies of each other; keys and shingle hashes have 64 bits; a null doc_id
ranks above all others; rows without a doc_id stay; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.llm import simhash
from graphquarry.llm.common import join_hot, materialise, release

SHINGLE = 5
BANDS = 20
ROWS = 4
LIGHT = 8
SEED = 11


def shingle_hashes(text: str | None) -> tuple[int, np.ndarray]:
    """The key of the folded text and the distinct hashes of its shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    key = int.from_bytes(xxhash.xxh64_digest(joined, 7), "big", signed=True)
    if len(words) <= SHINGLE:
        return key, np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    h = xxhash.xxh64_intdigest
    return key, np.unique(np.array([h(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band, of its ROWS min-hashes and its number."""
    rng = np.random.default_rng(SEED)
    mask = rng.integers(0, 2**64, BANDS * ROWS, np.uint64)
    odd = rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[i : i + 2048, None] ^ mask) * odd).min(0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return [int.from_bytes(xxhash.xxh64_digest(b.tobytes(), i), "big", signed=True) for i, b in enumerate(bands)]


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the key of the folded text), sim (its fingerprint), n (its distinct shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, sizes, bands = [], [], [], []
            for t in b.column(1):
                key, hashes = shingle_hashes(t.as_py())
                fps.append(key)
                sims.append(majority(hashes))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes))
            columns = [b.column(0), pa.array(fps, pa.int64()), pa.array(sims, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "sim", "n", "bands"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long, sim long, n int, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """fp, hashes (the distinct ones of its shingles); a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                found = [shingle_hashes(t.as_py()) for t in b.column(0).slice(lo, 256)]
                sets = pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), sets], names=["fp", "hashes"])

    return docs.select("text").mapInArrow(run, "fp long, hashes array<long>")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def sizes_fit(x: str, y: str) -> Column:
    """Whether sets of these sizes can have a Jaccard similarity of 0.8."""
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def pivot_candidates(marked: DataFrame) -> DataFrame:
    """Pairs of distinct texts by the SimHash operator: those with equal fingerprints, and with linked ones: a, b."""
    sims = materialise(marked.groupBy("sim").agg(F.min("fp").alias("least")), "neardup-sims")
    linked = simhash.links(sims.select(F.col("sim").alias("fp")), sims.count())
    texts = marked.select("sim", "fp").distinct().join(sims, "sim").where("fp <> least").select(*ordered("fp", "least"))
    x, y = (sims.select(F.col("sim").alias(c), F.col("least").alias(f"_{c}")) for c in ("a", "b"))
    return texts.union(linked.join(x, "a").join(y, "b").select(*ordered("_a", "_b")))


def band_candidates(marked: DataFrame, light: int = LIGHT) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct texts that share a small bucket, or a large one with its hub: a, b. The texts of large buckets: fp."""
    met = materialise(marked.select("fp", "n", F.explode("bands").alias("key")).distinct(), "neardup-bands")
    sizes = met.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    crowded = materialise(join_hot(met, sizes.withColumn("weight", F.col("size")), ["key"], "weight", met.count(), "inner"), "neardup-buckets")
    small, large = crowded.where(F.col("size") <= light), crowded.where(F.col("size") > light)
    left, right = (small.select("key", F.col("fp").alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & sizes_fit("na", "nb")).select("a", "b")
    score = crowded.groupBy("fp").agg(F.sum("size").alias("score"))
    best = F.max(F.struct("score", "fp", "n"))
    hubs = large.join(score, "fp").groupBy("key").agg(best["fp"].alias("hub"), best["n"].alias("nh"), F.count("*").alias("weight"))
    starred = join_hot(large, hubs, ["key"], "weight", met.count(), "inner").where((F.col("fp") != F.col("hub")) & sizes_fit("n", "nh")).select(*ordered("fp", "hub"))
    return pairs.union(starred), large.select("fp").distinct()


def sets_of(docs: DataFrame, reps: DataFrame, fps: DataFrame) -> DataFrame:
    """fp, hashes: a row for each of fps, read from the text of its first document."""
    need = materialise(reps.join(fps, "fp").select("fp", "first"), "neardup-need")
    rows = docs.select("doc_id", "text").join(need.select("first").distinct(), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    return materialise(shingle_sets(rows).join(need.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "neardup-sets")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of 0.8 or more."""
    a, b = (sets.select(F.col("fp").alias(c), F.col("hashes").alias(f"_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    # In whole numbers: shared / (|a| + |b| - shared) >= 4 / 5.
    return pairs.join(a, "a").join(b, "b").where(9 * shared >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")


def prefix_candidates(sets: DataFrame, tree: DataFrame) -> DataFrame:
    """Pairs of texts that share a prefix shingle and aren't connected by tree yet: a, b."""
    each = materialise(sets.select("fp", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "neardup-shingles")
    held = each.groupBy("h").agg(F.count("*").alias("held"))
    # A shingle of one text is in no other: it only takes its place in the order.
    ranked = join_hot(each, held.withColumn("texts", F.col("held")), ["h"], "held", each.count(), "inner")
    order = F.array_sort(F.collect_list(F.struct("texts", "h")))
    length = F.col("n") - F.floor((F.col("n") * 4 + 4) / 5).cast("int") + 1  # n - ceil(0.8 n) + 1
    prefix = F.filter(F.transform(F.slice("_o", 1, length), lambda x, i: F.struct(x["h"].alias("h"), x["texts"].alias("texts"), i.alias("at"))), lambda x: x["texts"] > 1)
    firsts = ranked.groupBy("fp", "n").agg(order.alias("_o")).select("fp", "n", F.explode(prefix).alias("_p"))
    rooted = firsts.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n", "_p.h", "_p.at")
    lists = materialise(rooted, "neardup-prefixes")
    groups = lists.groupBy("h", "root").agg(F.count("*").alias("n"))
    largest = groups.groupBy("h").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1")
    side = lambda df, p: df.select("h", *[F.col(c).alias(p + c) for c in ("fp", "root", "n", "at")])
    others, every = side(lists.join(largest, "h").where("root <> main"), "x_"), side(lists, "y_")
    # At the first shingle that two texts share, none before it is shared, so what follows in either bounds what they have in common.
    rest = F.least(F.expr("x_n - x_at"), F.expr("y_n - y_at"))
    fits = (F.col("x_root") != F.col("y_root")) & sizes_fit("x_n", "y_n") & (9 * rest >= 4 * F.expr("x_n + y_n"))
    return others.join(every, ["h"]).where(fits).select(*ordered("x_fp", "y_fp")).distinct()


def links(docs: DataFrame, marked: DataFrame, reps: DataFrame, light: int = LIGHT) -> DataFrame:
    """Links between similar texts, enough of them for the components of all: a, b."""
    banded, crowd = band_candidates(marked, light)
    found = materialise(banded.union(pivot_candidates(marked)).distinct(), "neardup-candidates")
    crowd = materialise(crowd, "neardup-crowd")
    ends = found.select(F.col("a").alias("fp")).union(found.select(F.col("b").alias("fp"))).union(crowd).distinct()
    sets = sets_of(docs, reps, ends)
    tree = materialise(simhash.connected(materialise(alike(found, sets), "neardup-links")), "neardup-tree")
    late = alike(prefix_candidates(sets.join(crowd, "fp", "left_semi"), tree), sets)
    out = materialise(tree.where("node <> root").select(*ordered("node", "root")).union(late), "neardup-all-links")
    release(found, crowd, sets)
    return out


def components(docs: DataFrame, light: int = LIGHT) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of all that are reachable over links)."""
    marked = materialise(marks(docs), "neardup-marks")
    reps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_docs")), "neardup-reps")
    return simhash.grouped(marked.select("doc_id", "fp"), reps, links(docs, marked, reps, light))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id names their component: one document of each group stays."""
    return simhash.staying(docs, components(docs, **how))
