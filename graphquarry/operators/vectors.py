"""Vector search: exact similarities as Columns, top-k, joins, and searches grouped by file."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _double(a), _double(b)
    return _same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclid(a: Column | str, b: Column | str) -> Column:
    a, b = _double(a), _double(b)
    return _same_length(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False), "euclidean": (euclid, False)}


def scored(points: DataFrame, query: DataFrame, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """points with score, for the one-row query (column vector), which is broadcast."""
    measure, _ = METRICS[metric]
    one = F.broadcast(query.select(F.col(vector).alias("_query")).limit(1))
    return points.join(one, F.lit(True)).withColumn("score", measure(vector, "_query")).drop("_query")


def knn(points: DataFrame, query: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, threshold: float = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best points by score, then key. Filters come before scoring; a threshold of 0 is none."""
    _, larger = METRICS[metric]
    out = scored(points if where is None else points.where(where), query, metric, vector)
    if threshold > 0:
        out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score") if larger else F.asc("score"), key).limit(k)


#: Queries that meet all points in one scan, and points that meet them at once: a task holds a block of their scores.
QUERY_BLOCK = 4096
POINTS_AT_ONCE = 512


def matrix(vectors: pa.Array | pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """rows x size, from lists of numbers of equal length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    size = size if size is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != size).any():
        raise ValueError("vectors differ in length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), size)


def block_scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """points x queries, larger is better. Rounded, so that equal vectors score alike wherever they stand in a block."""
    if metric in ("euclid", "euclidean"):
        return np.round(-np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ q.T + (q * q).sum(1), 0)), 9)
    out = x @ q.T
    if metric == "cosine":
        norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))
        out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    return np.round(out, 12)


class BestRows:
    """The k best rows of each query so far, by score, then key."""

    def __init__(self, k: int, ids: np.ndarray, q: np.ndarray, metric: str):
        self.k, self.ids, self.q, self.metric = k, ids, q, metric
        self.scores, self.keys = np.full((k, len(ids)), -np.inf), np.full((k, len(ids)), np.iinfo(np.int64).max)

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        scores = block_scores(self.metric, x, self.q)
        scores[keys[:, None] == self.ids] = -np.inf
        # Only queries that the block may change are sorted again: few, once the first blocks are in.
        change = np.flatnonzero(scores.max(0) >= self.scores[-1])
        if len(change):
            s = np.vstack([self.scores[:, change], scores[:, change]])
            k = np.vstack([self.keys[:, change], np.broadcast_to(keys[:, None], (len(keys), len(change)))])
            best = np.lexsort((k, -s), axis=0)[: self.k]
            self.scores[:, change], self.keys[:, change] = np.take_along_axis(s, best, 0), np.take_along_axis(k, best, 0)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and keys."""
        at, query = np.nonzero(np.isfinite(self.scores))
        return self.ids[query], self.keys[at, query]


def knn_join(queries: DataFrame, points: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """For each query its k best other points: query_id, key, score, rank. Exact; keys are whole numbers, null vectors take no part.

    Queries are counted and dealt by hash into blocks of about `block` rows; a block is held by every task as a matrix, meets the
    points in products of matrices, and k candidates a query and task move on. These are scored once more as Columns.
    """
    measure, larger = METRICS[metric]
    spark = points.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), _double(vector).alias("_query"))
    rows = points.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), _double(vector).alias("_v"))
    n = max(1, -(-asked.count() // block))
    kept = []
    for b in range(n):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toArrow()
        if not own.num_rows:
            continue
        held = spark.sparkContext.broadcast((own.column(0).to_numpy().astype(np.int64), matrix(own.column(1))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = BestRows(k, *held.value, metric)
            for rows in batches:
                for at in range(0, rows.num_rows, POINTS_AT_ONCE):
                    part = rows.slice(at, POINTS_AT_ONCE)
                    best.add(part.column(0).to_numpy(), matrix(part.column(1), best.q.shape[1]))
            ids, keys = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["query_id", key])

        kept.append(rows.mapInArrow(run, f"query_id long, `{key}` long"))
    if not kept:
        return points.sparkSession.createDataFrame([], f"query_id long, `{key}` long, score double, rank int")
    pairs = reduce(DataFrame.unionByName, kept)
    scored = pairs.join(rows, key).join(asked, "query_id").select("query_id", key, measure("_v", "_query").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if larger else F.asc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert_points(old: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """old with new's points in place of those of the same key; the last of repeated new ones is not defined, so new must have distinct keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def count_points(points: DataFrame, where: Column | None = None) -> DataFrame:
    return (points if where is None else points.where(where)).agg(F.count("*").alias("n"))


def recommend(points: DataFrame, positive: list, negative: list, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k points closest to the mean of positive minus the mean of negative examples."""
    sign = F.when(F.col(key).isin(*positive), F.lit(1.0 / len(positive)))
    if negative:
        sign = sign.when(F.col(key).isin(*negative), F.lit(-1.0 / len(negative)))
    parts = points.withColumn("_sign", sign).where("_sign IS NOT NULL").select("_sign", F.posexplode(_double(vector)).alias("i", "x"))
    summed = parts.groupBy("i").agg(F.sum(F.col("_sign") * F.col("x")).alias("x"))
    mean = summed.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))
    return knn(points.where(~F.col(key).isin(*positive, *negative)), mean, k, key=key, vector=vector)


def group_hits(hits: DataFrame, group: str, key: str) -> DataFrame:
    """group, average score, number of hits and best hit: chunks of files become files."""
    best = F.max_by(key, F.struct("score", -F.col(key)))
    return hits.groupBy(group).agg(F.avg("score").alias("avg_score"), F.count("*").alias("n_chunks"), best.alias("best_chunk"))


def search_content(points: DataFrame, query: DataFrame, limit: int, group: str, overfetch: int = 3, min_score: float = 0, where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The best groups by the average score of their hits among the overfetch * limit best points."""
    hits = knn(points, query, overfetch * limit, where=where, threshold=min_score, key=key)
    return group_hits(hits, group, key).orderBy(F.desc("avg_score"), group).limit(limit)


def search_hybrid(points: DataFrame, query: DataFrame, rows: DataFrame, on: tuple[str, str], where: Column, limit: int, key: str = "vec_id") -> DataFrame:
    """Hits joined with rows, filtered afterwards, so fewer than limit may come back."""
    hits = knn(points, query, 6 * limit, key=key)
    return hits.join(rows, hits[on[0]] == rows[on[1]]).where(where).orderBy(F.desc("score"), key).limit(limit)
