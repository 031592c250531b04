"""A property graph over DataFrames: nodes are tables, edges are foreign keys, traversals are joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.plans.model import EntityDef, RelDef
from graphquarry.sources.scratch import materialise


@dataclass(frozen=True)
class Hop:
    """One step of a path. direction: outgoing (along the foreign key) or incoming (against it)."""

    type: str
    target: str
    direction: str = "outgoing"
    where: Column | None = None


class PropertyGraph:
    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], entities: list[EntityDef]):
        self.spark, self.read, self.entities = spark, read, {e.label: e for e in entities}

    def entity(self, label: str) -> EntityDef:
        if label not in self.entities:
            raise KeyError(f"unknown label {label}")
        return self.entities[label]

    def nodes(self, label: str) -> DataFrame:
        return self.read(self.entity(label).table)

    def node(self, label: str, key) -> DataFrame:
        return self.nodes(label).where(F.col(self.entity(label).id) == key)

    def relationship(self, source: str, type_: str, target: str) -> RelDef:
        for r in self.entity(source).relationships:
            if (r.type, r.target) == (type_, target):
                return r
        raise KeyError(f"no relationship ({source})-[:{type_}]->({target})")

    def edges(self, source: str, type_: str, target: str) -> DataFrame:
        """src_id, dst_id and the edge's properties; rows without a target are no edges."""
        r = self.relationship(source, type_, target)
        props = [F.col(c).alias(name) for name, c in r.properties.items()]
        rows = self.nodes(source).where(F.col(r.foreign_key).isNotNull())
        return rows.select(F.col(self.entity(source).id).alias("src_id"), F.col(r.foreign_key).alias("dst_id"), *props)

    def _keys(self, label: str, hop: Hop) -> tuple[str, str]:
        """The columns of label's rows and of the target's rows that an edge makes equal."""
        if hop.direction == "outgoing":
            return self.relationship(label, hop.type, hop.target).foreign_key, self.entity(hop.target).id
        if hop.direction == "incoming":
            return self.entity(label).id, self.relationship(hop.target, hop.type, label).foreign_key
        raise ValueError(f"unknown direction {hop.direction}")

    def traverse(self, label: str, hops: list[Hop], where: Column | None = None) -> DataFrame:
        """One row for each path, with the columns of all its nodes."""
        out = self.nodes(label) if where is None else self.nodes(label).where(where)
        at = label
        for hop in hops:
            left, right = self._keys(at, hop)
            target = self.nodes(hop.target) if hop.where is None else self.nodes(hop.target).where(hop.where)
            out = out.join(target, out[left] == target[right])
            at = hop.target
        return out

    def related(self, label: str, hops: list[Hop], rows: DataFrame | None = None) -> DataFrame:
        """The rows of label with at least one path: a semi-join a hop, from the far end, so nothing needs deduplication."""
        return self._exists(self.nodes(label) if rows is None else rows, label, hops, "left_semi")

    def unrelated(self, label: str, hops: list[Hop], rows: DataFrame | None = None) -> DataFrame:
        return self._exists(self.nodes(label) if rows is None else rows, label, hops, "left_anti")

    def _exists(self, rows: DataFrame, label: str, hops: list[Hop], how: str) -> DataFrame:
        hop, rest = hops[0], hops[1:]
        target = self.nodes(hop.target) if hop.where is None else self.nodes(hop.target).where(hop.where)
        if rest:
            target = self._exists(target, hop.target, rest, "left_semi")
        left, right = self._keys(label, hop)
        return rows.join(target.select(F.col(right).alias("_key")), F.col(left) == F.col("_key"), how)

    def aggregate_related(self, label: str, hop: Hop, **aggregates: Column) -> DataFrame:
        """The rows of label that have related rows, with aggregates over these; the related side is grouped before the join."""
        left, right = self._keys(label, hop)
        target = self.nodes(hop.target) if hop.where is None else self.nodes(hop.target).where(hop.where)
        grouped = target.groupBy(F.col(right).alias("_key")).agg(*[c.alias(n) for n, c in aggregates.items()])
        return self.nodes(label).join(grouped, F.col(left) == F.col("_key")).drop("_key")

    def any_direction(self, a: str, type_: str, b: str) -> DataFrame:
        """Edges between a and b seen from either end: src_label, src_id, dst_label, dst_id."""
        out = None
        for source, target in {(a, b), (b, a)}:
            try:
                e = self.edges(source, type_, target)
            except KeyError:
                continue
            ends = [F.lit(source).alias("src_label"), "src_id", F.lit(target).alias("dst_label"), "dst_id"]
            back = [F.lit(target).alias("src_label"), F.col("dst_id").alias("src_id"), F.lit(source).alias("dst_label"), F.col("src_id").alias("dst_id")]
            both = e.select(*ends).unionByName(e.select(*back))
            out = both if out is None else out.unionByName(both)
        if out is None:
            raise KeyError(f"no relationship {type_} between {a} and {b}")
        return out.distinct()

    def incident_edges(self, label: str, key) -> DataFrame:
        """type, direction, other label and other id (as strings) of the edges of one node."""
        parts = []
        for e in self.entities.values():
            for r in e.relationships:
                pairs = self.nodes(e.label).select(F.col(e.id).alias("s"), F.col(r.foreign_key).alias("t")).where("t IS NOT NULL")
                if e.label == label:
                    parts.append((r, "outgoing", r.target, pairs.where(F.col("s") == key).select(F.col("t").alias("o"))))
                if r.target == label:
                    parts.append((r, "incoming", e.label, pairs.where(F.col("t") == key).select(F.col("s").alias("o"))))
        if not parts:
            return self.spark.createDataFrame([], "type string, direction string, other_label string, other_id string")
        rows = [
            p.select(F.lit(r.type).alias("type"), F.lit(d).alias("direction"), F.lit(o).alias("other_label"), F.col("o").cast("string").alias("other_id"))
            for r, d, o, p in parts
        ]
        out = rows[0]
        for x in rows[1:]:
            out = out.unionByName(x)
        return out

    def schema(self) -> DataFrame:
        """kind (label, relationship, property) and name: what the graph holds, without reading any row."""
        names = {("label", x) for x in self.entities}
        names |= {("relationship", r.type) for e in self.entities.values() for r in e.relationships}
        for e in self.entities.values():
            names |= {("property", c) for c in e.properties or self.nodes(e.label).columns}
        return self.spark.createDataFrame(sorted(names), "kind string, name string")

    def neighbours(self, label: str, key, type_: str | None = None, limit: int | None = None) -> DataFrame:
        """type, other_label, other_id of nodes one edge away, whichever way it points, each once; of one type, if given."""
        edges = self.incident_edges(label, key)
        own = edges if type_ is None else edges.where(F.col("type") == type_)
        once = own.select("type", "other_label", "other_id").distinct()
        return once if limit is None else once.orderBy("other_label", "other_id", "type").limit(limit)

    def sharing(self, label: str, through: str, rows: Column) -> DataFrame:
        """Other rows of label that share a value of a column (a foreign key) with those for which `rows` holds; distinct ids."""
        e = self.entity(label)
        mine = self.nodes(label).where(rows).select(F.col(through).alias("_value"), F.col(e.id).alias("_id")).distinct()
        others = self.nodes(label).join(mine.select("_value").distinct(), F.col(through) == F.col("_value"), "left_semi")
        ids = others.select(F.col(e.id).alias("related")).distinct()
        return ids.join(mine.select("_id").distinct(), F.col("related") == F.col("_id"), "left_anti")

    def statistics(self) -> DataFrame:
        """kind, name and n: nodes of each label, edges of each relationship type, labels that have each property. One scan a table."""
        parts, properties = [], {}
        for e in self.entities.values():
            nodes = self.nodes(e.label)
            counts = [F.struct(F.lit("label").alias("kind"), F.lit(e.label).alias("name"), F.count("*").alias("n"))]
            counts += [F.struct(F.lit("relationship").alias("kind"), F.lit(r.type).alias("name"), F.count(r.foreign_key).alias("n")) for r in e.relationships]
            row = nodes.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)])
            parts.append(row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(counts))])).alias("c")).select("c.*"))
            for c in e.properties or nodes.columns:
                properties[c] = properties.get(c, 0) + 1
        counted = reduce(DataFrame.unionByName, parts).groupBy("kind", "name").agg(F.sum("n").alias("n"))
        return counted.unionByName(self.spark.createDataFrame([("property", c, n) for c, n in sorted(properties.items())], "kind string, name string, n long"))

    def reach(self, label: str, parent: str, roots: Column, max_hops: int = 10) -> DataFrame:
        """id and hops (the fewest) of every node below the roots along a self-reference, up to max_hops.

        Each hop starts from the nodes that the one before it found first, once each, and is written out: cycles and
        several ways to a node cost nothing, and the plan stays as long as the number of hops.
        """
        e = self.entity(label)
        pairs = self.nodes(label).select(F.col(e.id).alias("id"), F.col(parent).alias("up"))
        start = self.nodes(label).where(roots).select(F.col(e.id).alias("id")).distinct()
        found = front = materialise(start.withColumn("hops", F.lit(0)), "reach")
        for hop in range(1, max_hops + 1):
            below = front.select(F.col("id").alias("up")).join(pairs, "up").select("id").distinct()
            front = materialise(below.join(found, "id", "left_anti").withColumn("hops", F.lit(hop)), "reach")
            if front.isEmpty():
                break
            found = found.unionByName(front)
        return found
