"""Nodes, edges and vectors of entities as one store: every ingestion and removal is seen in all views or in none.

Each view is a change table (its key, runs of changes, tombstones). An operation stages its changes view by view
as files that nobody reads yet, and then puts one manifest in place that names them all. If a view fails,
what was staged is deleted and InconsistentWrite is raised: there is nothing to undo in the other views. A batch may
also be taken apart: `ingest_batch` keeps the rows that reach the graph though their vectors can't be made, and says so for each key.

Who is who: a row needs an id; a row whose embed fields are empty has no vector (in a strict
ingestion that fails the whole batch); an entity without a vector definition has no such view, and its rows succeed in the graph alone.
Rows of one batch have distinct ids, else any one of them counts. An existing node keeps the properties that the new row leaves null. A relationship is made where the key isn't null and the
target exists, once; one whose key has changed is replaced; removing a node removes its edges at either end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from graphquarry.operators.ingest import embed_text
from graphquarry.plans.graph import PropertyGraph
from graphquarry.plans.model import EntityDef
from graphquarry.sources.store import Manifest
from graphquarry.streaming.changelog import ChangeTable, StepFailed, commit_together, sweep

SEQ = "_seq"
STATUS = "in_graph boolean, in_vectors boolean, n_edges long, error string"


class InconsistentWrite(RuntimeError):
    """A view failed; no view was changed."""

    def __init__(self, operation: str, view: str, cause: Exception):
        super().__init__(f"{operation} failed in {view}: {cause}; nothing was changed")
        self.operation, self.view = operation, view


class DualStore:
    """embed(df, text) -> df with an `embedding` column. Labels that were never written are read from the graph's own tables."""

    def __init__(self, spark: SparkSession, root: str, graph: PropertyGraph, embed: Callable[[DataFrame, str], DataFrame], buckets: int = 16):
        self.spark, self.root, self.embed, self.buckets = spark, root, embed, buckets
        self.manifest, self._outer = Manifest(spark, root), graph
        self.graph = PropertyGraph(spark, self._read_table, [*graph.entities.values()])

    # Views
    def _table(self, name: str, fields: StructType, key: tuple[str, ...]) -> ChangeTable:
        return ChangeTable(self.spark, self.root, name, StructType([*fields.fields]).add(StructField(SEQ, LongType())), key, (SEQ,), self.buckets)

    def _nodes(self, e: EntityDef) -> ChangeTable:
        return self._table(f"nodes-{e.label}", self._outer.nodes(e.label).schema, (e.id,))

    def _edges(self, e: EntityDef, type_: str, target: str) -> ChangeTable:
        ends = self._outer.edges(e.label, type_, target).schema
        return self._table(f"edges-{e.label}-{type_}-{target}", ends, ("src_id", "dst_id"))

    def _points(self, e: EntityDef) -> ChangeTable:
        own = self._outer.nodes(e.label).schema
        fields = StructType().add("vec_id", own[e.id].dataType).add("embedding", ArrayType(FloatType()))
        for c in e.vector.metadata:
            fields = fields.add(c, own[c].dataType) if c in own.names else fields
        return self._table(f"points-{e.label}", fields, ("vec_id",))

    def _read(self, table: ChangeTable, value: dict | None = None) -> DataFrame:
        states = self.manifest.load()[1] if value is None else value
        return table.read(states.get(table.name, {})).drop(SEQ)

    def _read_table(self, name: str) -> DataFrame:
        e = next(x for x in self._outer.entities.values() if x.table == name)
        return self._read(self._nodes(e)) if self._nodes(e).name in self.manifest.load()[1] else self._outer.read(name)

    def nodes(self, label: str) -> DataFrame:
        return self.graph.nodes(label)

    def edges(self, source: str, type_: str, target: str) -> DataFrame:
        return self._read(self._edges(self.graph.entity(source), type_, target))

    def points(self, label: str) -> DataFrame:
        return self._read(self._points(self.graph.entity(label)))

    # Staging
    def _put(self, states: dict, table: ChangeTable, seq: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        with_seq = [x.withColumn(SEQ, F.lit(seq).cast("long")) if x is not None else None for x in (upserts, deletes)]
        states[table.name] = table.stage(states.get(table.name, {}), *with_seq)

    def _run(self, operation: str, steps: list[tuple[str, Callable[[dict, int], None]]]) -> None:
        try:
            commit_together(self.manifest, steps)
        except StepFailed as e:
            raise InconsistentWrite(operation, e.step, e.cause) from e

    def _seeded(self, e: EntityDef, states: dict, seq: int) -> None:
        """Before its first change, a label's rows in the graph's own table are taken over."""
        table = self._nodes(e)
        if table.name not in states:
            self._put(states, table, 0, self._outer.nodes(e.label))

    def _stage_nodes(self, e: EntityDef, rows: DataFrame) -> Callable[[dict, int], None]:
        def step(states: dict, seq: int) -> None:
            self._seeded(e, states, seq)
            table = self._nodes(e)
            old = self._read(table, states).select(*[F.col(c).alias(f"_o_{c}") for c in table.schema.names if c != SEQ])
            known = rows.join(old, F.col(e.id) == F.col(f"_o_{e.id}"), "left")
            filled = [F.coalesce(c, f"_o_{c}").alias(c) if c in rows.columns else F.col(f"_o_{c}").alias(c) for c in table.schema.names if c != SEQ]
            self._put(states, table, seq, known.select(*filled))

        return step

    def _stage_edges(self, e: EntityDef, rows: DataFrame, type_: str, target: str) -> Callable[[dict, int], None]:
        def step(states: dict, seq: int) -> None:
            rel, table, t = self.graph.relationship(e.label, type_, target), self._edges(e, type_, target), self.graph.entity(target)
            nodes = self._nodes(t)
            ends = (self._read(nodes, states) if nodes.name in states else self._outer.nodes(target)).select(F.col(t.id).alias("_t"))
            props = [F.col(c).alias(n) for n, c in rel.properties.items()]
            wanted = rows.where(F.col(rel.foreign_key).isNotNull()).select(F.col(e.id).alias("src_id"), F.col(rel.foreign_key).alias("dst_id"), *props)
            new = wanted.join(ends, F.col("dst_id") == F.col("_t"), "left_semi")
            mine = self._read(table, states).join(rows.where(F.col(rel.foreign_key).isNotNull()).select(F.col(e.id).alias("src_id")), "src_id", "left_semi")
            stale = mine.join(new, ["src_id", "dst_id"], "left_anti").select("src_id", "dst_id")
            self._put(states, table, seq, new, stale)

        return step

    def _stage_points(self, e: EntityDef, rows: DataFrame) -> Callable[[dict, int], None]:
        def step(states: dict, seq: int) -> None:
            table = self._points(e)
            payload = [c for c in table.schema.names if c not in ("vec_id", "embedding", SEQ)]
            text = rows.select(F.col(e.id).alias("vec_id"), self._text(e, rows).alias("_embed"), *payload)
            made = self.embed(text, "_embed").drop("_embed")
            self._put(states, table, seq, made.withColumn("embedding", F.col("embedding").cast("array<float>")).select("vec_id", "embedding", *payload))

        return step

    def _text(self, e: EntityDef, rows: DataFrame) -> Column:
        return embed_text(*[c for c in e.vector.embed_fields if c in rows.columns])

    # Operations
    def ingest(self, label: str, rows: DataFrame) -> DataFrame:
        """All rows into all views, or an error and none. One row a key: STATUS."""
        return self._ingest(label, rows, strict=True)

    def ingest_batch(self, label: str, rows: DataFrame) -> DataFrame:
        """Rows that one view can't take go into the other; those without an id into none."""
        return self._ingest(label, rows, strict=False)

    def _ingest(self, label: str, rows: DataFrame, strict: bool) -> DataFrame:
        e = self.graph.entity(label)
        has_id = F.col(e.id).isNotNull()
        has_text = self._text(e, rows) != "" if e.vector else F.lit(False)
        if strict and not rows.where(~has_id if not e.vector else ~(has_id & has_text)).isEmpty():
            raise InconsistentWrite("ingest", "vectors" if e.vector else "graph", ValueError("rows without an id or without text to embed"))
        good = rows.where(has_id)
        steps = [("nodes", self._stage_nodes(e, good))]
        steps += [(f"edges {r.type}", self._stage_edges(e, good, r.type, r.target)) for r in e.relationships]
        if e.vector:
            steps.append(("vectors", self._stage_points(e, good.where(has_text))))
        self._run("ingest", steps)
        return self._status(e, rows, has_text)

    def _status(self, e: EntityDef, rows: DataFrame, has_text: Column) -> DataFrame:
        """What the committed views hold of the rows: read back, not assumed."""
        asked = rows.select(F.col(e.id), F.coalesce(has_text, F.lit(False)).alias("_text"))
        nodes = self.nodes(e.label).select(F.col(e.id).alias("_n"))
        out = asked.join(nodes, F.col(e.id) == F.col("_n"), "left")
        in_vectors, n_edges = F.lit(None).cast("boolean"), F.lit(0).cast("long")
        if e.vector:
            out = out.join(self.points(e.label).select(F.col("vec_id").alias("_p")), F.col(e.id) == F.col("_p"), "left")
            in_vectors = F.col("_p").isNotNull() & F.col("_text")
        edges = [self.edges(e.label, r.type, r.target).select("src_id") for r in e.relationships]
        if edges:
            counted = reduce(DataFrame.unionByName, edges).groupBy("src_id").agg(F.count("*").alias("_e"))
            out, n_edges = out.join(counted, F.col(e.id) == F.col("src_id"), "left"), F.coalesce("_e", F.lit(0))
        error = F.when(F.col(e.id).isNull(), "no id").when(~in_vectors, "no text to embed")
        return out.select(e.id, F.col("_n").isNotNull().alias("in_graph"), in_vectors.alias("in_vectors"), n_edges.alias("n_edges"), error.alias("error"))

    def remove(self, label: str, ids: DataFrame) -> None:
        """Takes the nodes, their edges at either end and their points out of all views, or raises and changes none."""
        e = self.graph.entity(label)
        gone = ids.select(F.col(e.id)).where(F.col(e.id).isNotNull())

        def nodes(states: dict, seq: int) -> None:
            self._seeded(e, states, seq)
            self._put(states, self._nodes(e), seq, None, gone)

        def edges(table: ChangeTable, end: str) -> Callable[[dict, int], None]:
            def step(states: dict, seq: int) -> None:
                keys = self._read(table, states).join(gone.select(F.col(e.id).alias(end)), end, "left_semi").select("src_id", "dst_id")
                self._put(states, table, seq, None, keys)

            return step

        steps = [("nodes", nodes)]
        for source in self.graph.entities.values():
            for r in source.relationships:
                ends = [end for end, own in (("src_id", source.label), ("dst_id", r.target)) if own == label]
                steps += [(f"edges {r.type}", edges(self._edges(source, r.type, r.target), end)) for end in ends]
        if e.vector:
            steps.append(("vectors", lambda states, seq: self._put(states, self._points(e), seq, None, gone.select(F.col(e.id).alias("vec_id")))))
        self._run("remove", steps)

    def sweep(self, keep: int = 2) -> None:
        """Deletes files that none of the last `keep` versions reads."""
        sweep(self.manifest, keep)


def summary(status: DataFrame) -> DataFrame:
    """total, succeeded, partially_succeeded, failed of a status. A view that an entity doesn't have isn't missed."""
    g, v = F.col("in_graph"), F.coalesce("in_vectors", "in_graph")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return status.agg(F.count("*").alias("total"), n(g & v).alias("succeeded"), n(g != v).alias("partially_succeeded"), n(~g & ~v).alias("failed"))
