"""The engine behind one object: ingest, search, ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.functions.embed import Embedder, HashEmbedder, embed_distinct
from graphquarry.operators import insights, query
from graphquarry.operators.dual import DualStore, summary
from graphquarry.operators.vectors import knn
from graphquarry.plans import context, templates
from graphquarry.plans.graph import PropertyGraph
from graphquarry.sources import scratch


class EntityCollections:
    """The vectors of a store's entities, by collection name."""

    def __init__(self, store: DualStore):
        self.store = store

    def _label(self, name: str) -> str | None:
        return next((e.label for e in self.store.graph.entities.values() if e.vector and e.vector.collection == name), None)

    def exists(self, name: str) -> bool:
        return self._label(name) is not None

    def points(self, name: str) -> DataFrame:
        label = self._label(name)
        if label is None:
            raise KeyError(f"no collection {name}")
        return self.store.points(label)

    def search(self, name: str, query: DataFrame, k: int, where: Column | None = None, threshold: float = 0) -> DataFrame:
        return knn(self.points(name), query, k, "cosine", where, threshold)


class Engine:
    """Ingests into a store that commits nodes, edges and vectors together, and answers from what is committed."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, embedder: Embedder | None = None, root: str | None = None):
        """root: a folder that executors share, where the store lives on; a new one below spark.checkpoint.dir by default."""
        self.spark, self.embedder = spark, embedder or HashEmbedder()
        self.store = DualStore(spark, root or scratch.folder(spark, "engine"), graph, self.embed)
        self.graph, self.collections = self.store.graph, EntityCollections(self.store)

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        return embed_distinct(df, text, self.embedder)

    def ingest(self, label: str, rows: DataFrame) -> DataFrame:
        """Upserts rows into all views in one commit; returns the summary. Rows that only one view can take are partly done."""
        return summary(self.store.ingest_batch(label, rows))

    ingest_batch = sync = ingest

    def remove(self, label: str, ids: DataFrame) -> None:
        self.store.remove(label, ids)

    def search_similar(self, collection: str, text: str, k: int = 5, **how) -> DataFrame:
        one = self.spark.createDataFrame([(text,)], "text string")
        return self.collections.search(collection, self.embedder.embed(one, "text"), k, **how)

    def get_schema(self) -> DataFrame:
        return self.graph.schema()

    def get_example_entities(self, label: str, n: int = 2) -> DataFrame:
        rows = self.graph.nodes(label).withColumn("_label", F.lit(label))
        return query.example_entities(rows, n, "_label", self.graph.entity(label).id).drop("_label", "n_known")

    def retrieve_context(self, question: str) -> dict:
        found = context.detect(self.graph, question)
        return {"entities": found, "schema": context.relevant_schema(self.graph, set(found))}

    def detect_query_template(self, question: str):
        return templates.detect(question)

    def ask(self, question: str) -> DataFrame:
        return templates.answer(self.graph, question)

    execute_query = staticmethod(query.execute)
    execute_count = staticmethod(query.execute_count)
    execute_paginated = staticmethod(query.paginate)
    explain_query = staticmethod(query.explain)
    test_query = staticmethod(query.is_valid)
    extract_insights = staticmethod(insights.insights)
    suggest_visualizations = staticmethod(insights.suggest_charts)

    def answer_question(self, question: str) -> dict:
        """The rows, their statistics and chart hints."""
        rows = scratch.materialise(self.ask(question), "answer")
        return {"rows": rows, "insights": insights.insights(rows), "charts": insights.suggest_charts(rows.columns, rows.count())}
