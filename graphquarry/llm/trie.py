"""Conversation prefix trie, by family-first merging.

A conversation c is derived from its base, c - c % FAMILY: it takes the base's first h turns (h a hash of c) and goes on
with its own turns after its first h. Conversations and bases are cogrouped by the base's id; a task rebuilds a family's
conversations, at most FAMILY on either side of zero, and builds their small trie. Only the nodes of
those tries are shuffled and merged, by a 128-bit hash of the path of turns, so a turn that all families begin with counts once
a family, and with partial sums once a task.

What a node sums up over its subtree is merged the same way. Of the conversations in a node, the one with the smallest id owns
it, in exactly one family. A family adds to its own small trie the leaves it owns, and for each node the text of its
members but the owner's; those sums over small subtrees add up to the sums over the whole ones. So there is no
step by depth, and a trie of any depth takes the same few shuffles.

Turns travel as digests: 16 bytes of MD5 of role and text, and the text's length; a family is held by one task as
such digests, about 100 bytes a turn. The ids that end in a node are joined in order, family by family, in
strings of SPAN families, and hashed as they stream by: no task holds all ids of a node.

Defined cases: rows without conv_id belong to no conversation and are left out; a null turn stands first; turns alike in number
stand in the order of their digests, repeats included; a null role or text is empty; a conversation whose base is absent, or
that is left without a turn, ends in the root; an empty table has no nodes; further columns are ignored; c % FAMILY keeps the
sign of c.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import join_hot, materialise, release

FAMILY = 100
HEADS = 6
#: Families whose ids are joined to one string before it is hashed.
SPAN = 20
ROOT = hashlib.md5(b"").digest()
NODES = "family long, key binary, parent binary, depth long, n_chars long, n_convs long, first long, ends string"
SUMS = "key binary, depth long, first long, n_convs long, n_children long, parent_first long, n_leaves long, saved_tokens long"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """family, conv_id, turn, digest, n_chars of every turn that has a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull())
    c = F.col("conv_id").cast("long")
    return rows.select((c - c % FAMILY).alias("family"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars"))


def head_size(conv_id: int, heads: int = HEADS) -> int:
    """How many of its base's turns a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % heads


def in_order(turns: pa.Table) -> dict[int, list[tuple[bytes, int]]]:
    """conv_id -> its turns as (digest, n_chars), by turn, nulls first; conversations by id."""
    by = [("conv_id", "ascending"), ("turn", "ascending"), ("digest", "ascending")]
    turns = turns.take(pc.sort_indices(turns, sort_keys=by, null_placement="at_start"))
    out: dict[int, list[tuple[bytes, int]]] = {}
    for c, digest, n in zip(*(turns.column(x).to_pylist() for x in ("conv_id", "digest", "n_chars"))):
        out.setdefault(c, []).append((digest, n))
    return out


class SmallTrie:
    """A family's nodes, the root first, parents before children."""

    def __init__(self):
        self.at: dict[tuple[int, bytes], int] = {}
        self.keys, self.parents, self.depths, self.chars, self.counts = [ROOT], [-1], [0], [0], [0]
        self.first: list[int] = [0]
        self.ends: list[list[int]] = [[]]

    def add(self, conv_id: int, turns: list[tuple[bytes, int]]) -> None:
        """Conversations come in the order of their ids, so the first one in a node has the smallest."""
        node = 0
        self._enter(node, conv_id)
        for digest, n in turns:
            child = self.at.get((node, digest))
            if child is None:
                child = self.at[node, digest] = len(self.keys)
                self.keys.append(hashlib.md5(self.keys[node] + digest).digest())
                self.parents.append(node)
                self.depths.append(self.depths[node] + 1)
                self.chars.append(n)
                self.counts.append(0)
                self.first.append(conv_id)
                self.ends.append([])
            node = child
            self._enter(node, conv_id)
        self.ends[node].append(conv_id)

    def _enter(self, node: int, conv_id: int) -> None:
        if not self.counts[node]:
            self.first[node] = conv_id
        self.counts[node] += 1


def small_trie(own: pa.Table, base: pa.Table) -> SmallTrie:
    """The trie of a family: its conversations' turns, and those of the base."""
    begin = next(iter(in_order(base).values()), [])
    trie = SmallTrie()
    for c, turns in in_order(own).items():
        h = head_size(c)
        trie.add(c, begin[:h] + turns[h:])
    return trie


def family_nodes(digests: DataFrame) -> DataFrame:
    """NODES: the nodes of each family's trie; ends: the ids of the conversations that end there, joined."""

    def build(key: tuple, own: pa.Table, base: pa.Table) -> pa.Table:
        t = small_trie(own, base)
        parents = [t.keys[p] if p >= 0 else None for p in t.parents]
        ends = [",".join(map(str, e)) if e else None for e in t.ends]
        columns = [[key[0].as_py()] * len(t.keys), t.keys, parents, t.depths, t.chars, t.counts, t.first, ends]
        kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in NODES.split(", ")])

    bases = digests.where(F.col("conv_id") == F.col("family"))
    own = digests.groupBy("family").cogroup(bases.groupBy("family")).applyInArrow(build, NODES)
    return own


def merged(families: DataFrame) -> DataFrame:
    """key, first, n_children, n_families: the nodes of all families, each once."""
    nodes = materialise(families.groupBy("key").agg(F.first("parent").alias("parent"), F.min("first").alias("global_first"), F.count("*").alias("n_families")), "trie-nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n_children"))
    both = nodes.join(children.withColumnRenamed("parent", "_parent"), F.col("key") == F.col("_parent"), "left")
    return both.select("key", "global_first", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_families")


def family_sums(families: DataFrame, nodes: DataFrame) -> DataFrame:
    """SUMS: for each node of each family what the family adds to it."""

    def add_up(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("depth", "ascending")]))
        key, parent, depth, chars, counts, first, top, children = (t.column(c).to_pylist() for c in ("key", "parent", "depth", "n_chars", "n_convs", "first", "global_first", "n_children"))
        at = {k: i for i, k in enumerate(key)}
        owned = [a == b for a, b in zip(first, top)]
        leaves = [int(o and not c) for o, c in zip(owned, children)]
        saved = [(n - o) * c for n, o, c in zip(counts, owned, chars)]
        above = [at[p] if p is not None else -1 for p in parent]
        for i in range(len(key) - 1, 0, -1):
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
        columns = [key, depth, first, counts, children, [top[a] if a >= 0 else None for a in above], leaves, saved]
        kinds = [pa.binary(), *[pa.int64()] * 7]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SUMS.split(", ")])

    known = join_hot(families.drop("ends"), nodes, ["key"], "n_families", families.count(), "inner")
    return known.groupBy("family").applyInArrow(add_up, SUMS)


def ends_hashes(families: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes in which a conversation ends."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        done: tuple[list, list] = ([], [])
        for b in batches:
            for key, ids in zip(b.column(0), b.column(1)):
                key, ids = key.as_py(), ids.as_py().encode()
                if key == now:
                    sha.update(b"," + ids)
                    continue
                if sha:
                    done[0].append(now)
                    done[1].append(sha.hexdigest())
                now, sha = key, hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["end_key", "ends_sha256"])
            done = ([], [])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["end_key", "ends_sha256"])

    ends = families.where(F.col("ends").isNotNull()).withColumn("_span", F.floor(F.col("family") / (FAMILY * SPAN)))
    ordered = F.array_sort(F.collect_list(F.struct("family", "ends")))
    spans = ends.groupBy("key", "_span").agg(F.array_join(F.transform(ordered, lambda x: x["ends"]), ",").alias("ids"))
    return spans.repartition("key").sortWithinPartitions("key", "_span").select("key", "ids").mapInArrow(digest, "end_key binary, ends_sha256 string")


def build(conversations: DataFrame) -> DataFrame:
    """One row a node: key (of its path), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    digests = materialise(turn_digests(conversations), "trie-turns")
    families = materialise(family_nodes(digests), "trie-families")
    release(digests)
    sums = family_sums(families, merged(families))
    whole = sums.groupBy("key").agg(
        F.min("first").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.max("parent_first").alias("parent_conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.max("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    ended = whole.join(ends_hashes(families), F.col("key") == F.col("end_key"), "left")
    none = hashlib.sha256(b"").hexdigest()
    return ended.select(*whole.columns, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
