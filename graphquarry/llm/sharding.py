"""Sharding by a hierarchical weighted hash tree (DataFrame operations only).

Shards hang in racks and racks in regions. A row descends from the root: at each level every child of the
node where it stands draws a number from a hash of the row's doc_id and the child's path, scaled by the
child's weight (the sum of the weights below it), and the row goes to the child with the smallest draw.
A child's chance is its share of the weight, and the other children's draws don't depend on it. So when a weight
changes, rows cross into or out of the subtrees that hold it and no row moves between others.

The law is `key`: doc_id and the shard count decide. A shard that is added by grow() hangs in a region of its
own, so only draws against that region are new, and it takes rows only into itself. A shard added inside
an existing rack is possible (a tree is any list of shards), but raises the weights of that rack and region: rows
that come in from outside are dealt over the whole region, which isn't this law.

place() also numbers the rows of each shard without gaps. Rows alike in doc_id, size and checksum are counted
before anything is shuffled and numbered in blocks of at most COPIES_AT_ONCE; the rest is the distributed prefix sum
of the mixing operator over ranges of an even hash of all three, so no id, text or group of copies makes a large task.

Defined cases: a null text has no bytes (size 8, checksum 0); null is a key like any other, so all rows without
doc_id share a shard; repeated rows get slots of their own; an empty table gives an empty result; columns other than
doc_id and text are ignored; equal draws go to the child first by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import materialise, text_or_empty
from graphquarry.llm.mixing import prefix_sums

SHARDS, REGIONS, RACKS = 24, 2, 3
#: What a row takes besides its text.
OVERHEAD = 8
COPIES_AT_ONCE = 10_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


Tree = tuple[Shard, ...]


def layout(shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> Tree:
    """Shards of weight 1, spread as evenly as their number allows over racks, and racks over regions."""
    own = [s * regions * racks // shards for s in range(shards)]
    return tuple(Shard(s, r // racks, r % racks) for s, r in enumerate(own))


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """tree with one more shard, in a region of its own."""
    return (*tree, Shard(max(s.number for s in tree) + 1, max(s.region for s in tree) + 1, 0, weight))


def draw(key: Column, path: str, weight: float) -> Column:
    """An exponential draw of rate weight: the smallest of several is a child's with its share of their weights."""
    unit = (F.conv(F.substring(F.md5(F.concat(key, F.lit(path))), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 32))
    return -F.log(unit) / F.lit(float(weight))


def descend(key: Column, shards: Sequence[Shard], level: Callable[[Shard], int], path: str) -> Column:
    """The child of a node that a row goes to; shards are those below the node."""
    weights: dict[int, float] = {}
    for s in shards:
        weights[level(s)] = weights.get(level(s), 0.0) + s.weight
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(draw(key, f"{path}/{child}", w).alias("draw"), F.lit(child).alias("child")) for child, w in sorted(weights.items()) if w > 0]
    return F.array_min(F.array(*draws))["child"]


def choose(at: Column, options: dict[int, Column]) -> Column:
    """The option of the child where a row stands."""
    out = None
    for child, option in options.items():
        out = F.when(at == child, option) if out is None else out.when(at == child, option)
    return out


def assign(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """df with the shard that key falls to, as column `name`."""
    regions = sorted({s.region for s in tree})
    below = {r: [s for s in tree if s.region == r] for r in regions}
    racks = {r: descend(key, own, lambda s: s.rack, f"/{r}") for r, own in below.items()}
    places = {(s.region, s.rack): [x for x in tree if (x.region, x.rack) == (s.region, s.rack)] for s in tree}
    width = 1 + max(s.rack for s in tree)
    shards = {r * width + k: descend(key, own, lambda s: s.number, f"/{r}/{k}") for (r, k), own in places.items()}
    at_region = df.withColumn("_region", descend(key, tree, lambda s: s.region, ""))
    at_rack = at_region.withColumn("_place", F.col("_region") * width + choose(F.col("_region"), racks))
    return at_rack.withColumn(name, choose(F.col("_place"), shards).cast("int")).drop("_region", "_place")


def shard_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def place(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where each row goes, now and with one more shard."""
    tree = layout() if tree is None else tree
    text = text_or_empty("text")
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES_AT_ONCE)))
    blocks = alike.withColumn("_block", block).withColumn("_copies", F.least(F.lit(COPIES_AT_ONCE), F.col("_n") - F.col("_block") * COPIES_AT_ONCE).cast("long"))
    even = F.md5(F.concat_ws(":", shard_key(), "size", "text_crc32", "_block"))
    keyed = assign(assign(blocks, shard_key(), tree, "shard"), shard_key(), grow(tree), "grown_shard").withColumn("_key", even)
    held = materialise(keyed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "_key", "_copies"), "sharding")
    numbered = prefix_sums(held, ["shard"], "_key", "_copies", [])
    slot = F.explode(F.sequence(F.col("before"), F.col("before") + F.col("_copies") - 1))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
