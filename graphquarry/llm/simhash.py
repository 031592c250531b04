"""SimHash near-dedup with pivot distance tables.

Fingerprints are made from whole texts in Python workers; all else is DataFrame work on distinct
fingerprints. Links are all pairs that differ in `bits` bits or fewer; they are found from the pivot table alone.

* The table holds each fingerprint's Hamming distances to many reference fingerprints: to BASES random ones, and
  to each of these with one of b blocks of bits turned over.
* The difference between the distances to a base and to its turned companion depends on the bits of that block only. So two
  fingerprints that differ in 3 bits have equal differences, for all bases, in b - 3 blocks at least. Whoever
  agrees on the differences of some choice of b - 3 blocks meets in one bucket: no link is lost. b grows
  with the table, so that chance meetings stay rare.
* By the triangle inequality the distances of linked fingerprints to any reference differ by `bits` at most: pairs of a bucket
  with a larger difference in any coordinate are discarded, and the survivors are verified.
* In a bucket of more than LIGHT members, most of them within a few bits of each other, pairs would be too many. There the
  reference fingerprints are all values within two bits of a member, over the bits that the bucket leaves open, and the
  triangle inequality is used from its other side: a member at distance 1 or less and one at distance 2 or less from the same reference are
  linked. Any two linked ones have such a reference between them; each reference links its members to one of
  those within 1, so links stay linear in the bucket and the components are exactly those of all pairs.

Exact copies meet in one fingerprint first and are never paired. Defined cases: null, empty and wordless
texts have fingerprint zero and are linked like any other; a null doc_id ranks above all others (a component of nulls
has a null id); repeated rows (doc_id and text) count once in near_dedup(); an empty table gives an
empty result; further columns are ignored by components() and kept by near_dedup().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import join_hot, materialise, release

SHINGLE = 3
BITS = 3
BASES = 8
LIGHT = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: the majority over the XXH64 hashes of all word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        h, starts = xxhash.xxh64_intdigest, [0, *ends]
        hashes = [h(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        block = np.array(hashes[i : i + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((fingerprint(t.as_py(), shingle) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bases(n: int = BASES, seed: int = 2024) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n)]


def blocks(n: int, bits: int = BITS) -> list[int]:
    """The 64 bits cut into blocks, as masks: into more of them the more fingerprints there are."""
    count = bits + 2
    while n * 8 > 2 ** (64 * (count - bits) // count) and count < bits + 6:
        count += 1
    cuts = [64 * i // count for i in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(reps: DataFrame, masks: list[int], n: int = BASES) -> DataFrame:
    """fp with the distances to the bases, then to their companions, block by block."""
    references = bases(n) + [signed((p ^ m) % (1 << 64)) for m in masks for p in bases(n)]
    near = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in references]
    return reps.select("fp", F.array(*near).alias("pivots"))


def bucketed(table: DataFrame, masks: list[int], bits: int = BITS, n: int = BASES) -> DataFrame:
    """mask (the bits of the chosen blocks), key (of their distance differences), fp, pivots: a row for each choice."""
    turned = [[F.col("pivots")[i] - F.col("pivots")[n * (j + 1) + i] for i in range(n)] for j in range(len(masks))]
    choices = [
        F.struct(F.lit(signed(sum(masks[j] for j in chosen))).alias("mask"), F.xxhash64(*[x for j in chosen for x in turned[j]]).alias("key"))
        for chosen in combinations(range(len(masks)), len(masks) - bits)
    ]
    return table.select("fp", "pivots", F.explode(F.array(*choices)).alias("k")).select("k.*", "fp", "pivots")


def near_pairs(members: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs within small buckets whose pivot coordinates differ little, verified: a, b."""
    left = members.select("mask", "key", F.col("fp").alias("a"), F.col("pivots").alias("pa"))
    right = members.select("mask", "key", F.col("fp").alias("b"), F.col("pivots").alias("pb"))
    gap = F.array_max(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y))) <= bits
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return left.join(right, ["mask", "key"]).where((F.col("a") < F.col("b")) & gap & close).select("a", "b")


def ball_links(members: DataFrame) -> DataFrame:
    """Links within large buckets through references near their members: a, b. For three bits."""
    open_bits = F.filter(
        F.array(*[F.lit(signed(1 << i)) for i in range(64)]), lambda x: x.bitwiseAND(F.col("mask")) == 0
    )
    near = F.transform(F.array_append("_open", F.lit(0).cast("long")), lambda x: F.struct(x.alias("flip"), F.lit(True).alias("close")))
    far = F.flatten(
        F.transform(
            "_open",
            lambda x, i: F.transform(
                F.slice("_open", i + 2, F.size("_open")), lambda y: F.struct(x.bitwiseXOR(y).alias("flip"), F.lit(False).alias("close"))
            ),
        )
    )
    reach = (
        members.select("mask", "fp", open_bits.alias("_open"))
        .select("mask", "fp", F.explode(F.concat(near, far)).alias("r"))
        .select("mask", "fp", F.col("fp").bitwiseXOR(F.col("r.flip")).alias("value"), F.col("r.close").alias("close"))
    )
    centres = (
        reach.where("close").groupBy("mask", "value").agg(F.min("fp").alias("centre"))
    )
    linked = reach.join(centres, ["mask", "value"]).where("fp <> centre")
    return linked.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()


def links(reps: DataFrame, n: int, bits: int = BITS, light: int = LIGHT) -> DataFrame:
    """Links between distinct fingerprints, enough of them for the components of all: a, b."""
    if bits != BITS:
        raise ValueError("large buckets are linked for three bits")
    masks = blocks(n, bits)
    met = bucketed(pivot_table(reps, masks), masks, bits)
    sizes = met.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
    crowded = materialise(met.join(sizes, ["mask", "key"]), "simhash-buckets")
    pairs = near_pairs(crowded.where(F.col("size") <= light).drop("size"), bits)
    found = materialise(pairs.union(ball_links(crowded.where(F.col("size") > light))).distinct(), "simhash-links")
    release(crowded)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """node -> root, the smallest node of its component, for every node of the edges a, b.

    Alternates large stars (a node's larger neighbours move to its smallest one) with small stars (so do
    its smaller neighbours and itself) until all edges point at roots; each round is written out, so
    lineage stays short, and a node with a great many edges doesn't meet them in one task.
    """

    def hop(pairs: DataFrame, most: int) -> DataFrame:
        """(node, peer), of which there are `most` at most, with low, the least of node and peers."""
        low = pairs.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("low"), F.count("*").alias("n"))
        return join_hot(pairs, low, ["node"], "n", most, "inner")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("node", "peer").cast("decimal(38,0)"))).first())

    now = materialise(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("peer")).where("node <> peer").distinct(), "cc-edges")
    seen, before = state(now), None
    while seen != before:
        both = now.union(now.select(F.col("peer").alias("node"), F.col("node").alias("peer")))
        large = hop(both, 2 * seen[0]).where("peer > node").select(F.col("peer").alias("node"), F.col("low").alias("peer"))
        mid = materialise(large.where("node <> peer").distinct(), "cc-large")
        star = hop(mid, 2 * seen[0])
        small = star.where("peer <> low").select(F.col("peer").alias("node"), F.col("low").alias("peer"))
        small = small.union(star.where("node <> low").select("node", F.col("low").alias("peer")))
        last, now = now, materialise(small.distinct(), "cc-small")
        release(mid, last)
        seen, before = state(now), seen
    roots = now.select("node", F.col("peer").alias("root"))
    return roots.union(now.select(F.col("peer").alias("node"), F.col("peer").alias("root")).distinct())


def components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, light: int = LIGHT) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of all that are reachable over links)."""
    marked = materialise(fingerprints(docs, shingle), "simhash-fingerprints")
    reps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_docs")), "simhash-reps")
    return grouped(marked, reps, links(reps, reps.count(), bits, light))


def grouped(marked: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """marked (doc_id, fp) with component_id, from reps (fp, first, n_docs) and the links found between them."""
    tree = connected(found).withColumnRenamed("node", "fp")
    known = reps.join(tree, "fp")
    roots = known.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = known.join(roots, "root").select("fp", F.col("component_id").alias("_linked"))
    final = reps.join(linked, "fp", "left").select("fp", "n_docs", F.coalesce("_linked", "first").alias("component_id"))
    return join_hot(marked, final, ["fp"], "n_docs", marked.count(), "inner")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id names their component: one document of each group stays.

    Rows without a doc_id can't be named and stay, and so do different texts that share a doc_id.
    """
    return staying(docs, components(docs, **how))


def staying(docs: DataFrame, found: DataFrame) -> DataFrame:
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
