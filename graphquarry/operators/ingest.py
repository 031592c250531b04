"""Ingestion: idempotent upserts, deletes with their edges, relationship reconciliation, dual views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECRET_NAMES = ("password", "secret", "token", "api_key", "remember")


def project_properties(df: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns that exist (or all), without those whose names speak of secrets."""
    names = [c for c in (wanted or df.columns) if c in df.columns]
    return df.select(*[c for c in names if not any(s in c.lower() for s in SECRET_NAMES)])


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """The newest row of each key: an aggregate with map-side combine, so a key with many versions isn't sorted."""
    row = F.max_by(F.struct(*df.columns), F.struct(*version))
    return df.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


def upsert_nodes(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of old with the supplied (not null) properties of changes, and the new rows of changes."""
    c = changes.select(*[F.col(x).alias(f"_n_{x}") for x in changes.columns])
    both = old.join(c, F.col(key) == F.col(f"_n_{key}"), "full_outer")
    return both.select(*[F.coalesce(f"_n_{x}", x).alias(x) if x in changes.columns else F.col(x) for x in old.columns])


def delete_nodes(nodes: DataFrame, edges: list[tuple[DataFrame, tuple[str, ...]]], gone: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """What is left when the nodes in gone go: nodes, and edges, each given with its ends (src_id, dst_id) of that label."""
    ids = gone.select(F.col(key).alias("_gone"))
    left = nodes.join(ids, F.col(key) == F.col("_gone"), "left_anti")
    kept = []
    for e, ends in edges:
        for end in ends:
            e = e.join(ids, F.col(end) == F.col("_gone"), "left_anti")
        kept.append(e)
    return left, kept


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti")


def create_edges(wanted: DataFrame, sources: DataFrame, targets: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted edges (src_id, dst_id) whose ends exist and which aren't there yet, once each."""
    ok = wanted.join(sources.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(
        targets.select(F.col("id").alias("dst_id")), "dst_id", "left_semi"
    )
    return ok.join(existing.select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti").dropDuplicates(["src_id", "dst_id"])


def edge_status(rows: DataFrame, key: str, foreign_key: str, targets: DataFrame, existing: DataFrame) -> DataFrame:
    """src_id, dst_id, status: null_key, failed (no target), skipped (edge exists) or created."""
    e = rows.select(F.col(key).alias("src_id"), F.col(foreign_key).alias("dst_id"))
    t = targets.select(F.col("id").alias("_t")).distinct()
    x = existing.select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d")).distinct()
    j = e.join(t, F.col("dst_id") == F.col("_t"), "left").join(x, (F.col("src_id") == F.col("_s")) & (F.col("dst_id") == F.col("_d")), "left")
    status = F.when(F.col("dst_id").isNull(), "null_key").when(F.col("_t").isNull(), "failed").when(F.col("_s").isNotNull(), "skipped").otherwise("created")
    return j.select("src_id", "dst_id", status.alias("status"))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def sync_summary(status: DataFrame) -> DataFrame:
    s = F.col("status")
    return status.agg(
        _count(s != "null_key").alias("checked"), _count(s == "created").alias("created"), _count(s == "skipped").alias("skipped"), _count(s == "failed").alias("failed")
    )


def embed_text(*fields: str) -> Column:
    """The fields that are neither null nor empty, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields])


def ingest_status(nodes: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """key, in_graph, in_vectors for every row of either side, those without a key and repeated ones included."""
    g, v = nodes.select(F.col(key).alias("_g")), points.select(F.col(key).alias("_v"))
    j = g.join(v, F.col("_g") == F.col("_v"), "full_outer")
    return j.select(F.coalesce("_g", "_v").alias(key), F.col("_g").isNotNull().alias("in_graph"), F.col("_v").isNotNull().alias("in_vectors"))


def ingest_summary(status: DataFrame) -> DataFrame:
    g, v = F.col("in_graph"), F.col("in_vectors")
    return status.agg(
        F.count("*").alias("total"), _count(g & v).alias("succeeded"), _count(g != v).alias("partially_succeeded"), _count(~g & ~v).alias("failed")
    )


def chunk_positions(chunks: DataFrame, file: str = "file_id") -> DataFrame:
    """chunks with start_position and end_position: running lengths, overlap not counted."""
    w = Window.partitionBy(file).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    n = F.char_length("content")
    start = F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long")
    return chunks.withColumn("start_position", start).withColumn("end_position", (F.col("start_position") + n).cast("long"))


def store_query(memory: DataFrame, asked: DataFrame) -> DataFrame:
    """memory with asked (question, query) added under md5(question + query), each once."""
    keyed = asked.withColumn("id", F.md5(F.concat("question", "query")))
    return memory.join(keyed.select("id"), "id", "left_anti").unionByName(keyed.select(*memory.columns).dropDuplicates(["id"]))
