"""An approximate vector index: inverted lists with residual product codes, and an exact re-rank.

A k-means over a bounded sample gives the lists' centroids; what is left of a vector after its list's centroid is cut into
PARTS pieces, each coded by the nearest of 256 code vectors. Every row is indexed, as one Parquet table laid out by list: key, codes,
vector. A search ranks the lists by their centroids' distance and reads the codes of the nearest
`probes` lists alone (partition pruning); the `depth` best rows by the codes' distance are scored again by their vectors,
also read from those lists only. How many probes and how much depth a share of the true neighbours takes is measured by
tune(), on a bounded set of queries against all rows; with all lists and without a depth the search is exact.

No list makes a large task, however many rows are alike: a list is cut by hash into pieces of about
ROWS_AT_ONCE rows, and its queries into pieces of QUERIES_AT_ONCE. What the driver holds is the model and a
count a list: bounded by MOST_LISTS.

Rows without a vector aren't indexed; vectors of another length than the first one's are an error; rows of equal distance go by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.operators.query import top_per_group
from graphquarry.operators.vectors import METRICS, POINTS_AT_ONCE, BestRows, knn_join, matrix

#: Rows that train the model, drawn by a hash of the key.
SAMPLE = 20_000
#: Of these, rows that train the 256 codes of each part.
CODE_SAMPLE = 5_000
MOST_LISTS = 4096
PARTS = 16
ROUNDS = 8
ROWS_AT_ONCE = 50_000
QUERIES_AT_ONCE = 2_000
#: Queries that tune() compares with an exact search, and the depths it tries.
TUNING_QUERIES = 64
DEPTHS = (1, 2, 4, 8, 16, 32, 64, 128)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres; one that loses its rows starts again at a row far from its centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), False)].copy()
    for _ in range(ROUNDS):
        far = squared(x, centres)
        own = far.argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far[np.arange(len(x)), own], kind="stable")[: len(empty)]]
    return centres


@dataclass(frozen=True)
class Model:
    """Goes to tasks as its plain fields, since they can't import this class."""

    metric: str
    centres: np.ndarray  # lists x size
    codes: np.ndarray  # parts x 256 x size / parts

    def seen(self, x: np.ndarray) -> np.ndarray:
        """Vectors as the distances see them: of length 1 for the cosine."""
        if self.metric != "cosine":
            return x
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def cut(self, x: np.ndarray) -> np.ndarray:
        """rows x parts x size / parts, padded with zeros where the parts don't divide the size."""
        parts, _, width = self.codes.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row and its codes."""
        x = self.seen(x)
        lists = squared(x, self.centres).argmin(1)
        left = self.cut(x - self.centres[lists])
        return lists, np.stack([squared(left[:, p], c).argmin(1) for p, c in enumerate(self.codes)], 1).astype(np.uint8)

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(squared(self.seen(x), self.centres), axis=1, kind="stable")[:, :n]

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """For each query and part the distances from what it leaves in list `at` to the 256 code vectors."""
        left = self.cut(self.seen(x) - self.centres[at])
        return np.stack([squared(left[:, p], c) for p, c in enumerate(self.codes)], 1)


def train(x: np.ndarray, lists: int, metric: str, parts: int = PARTS, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    width = -(-x.shape[1] // parts)
    model = Model(metric, np.zeros((1, x.shape[1])), np.zeros((parts, 1, width)))
    x = model.seen(x)
    centres = k_means(x, lists, rng)
    some = x[rng.choice(len(x), min(CODE_SAMPLE, len(x)), False)]
    left = model.cut(some - centres[squared(some, centres).argmin(1)])
    codes = np.zeros((parts, 256, width))
    for p in range(parts):
        found = k_means(left[:, p], 256, rng)
        codes[p] = found[np.minimum(np.arange(256), len(found) - 1)]
    return Model(metric, centres, codes)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    model: Model
    counts: dict[int, int]
    key: str = "vec_id"
    probes: int = 8
    depth: int = 100

    @property
    def rows(self) -> DataFrame:
        """key, codes, embedding, list (the partition)."""
        return self.spark.read.schema(f"`{self.key}` long, codes binary, embedding array<double>, list int").parquet(f"{self.path}/rows")

    def save(self) -> None:
        parts = [("centre", i, 0, v.tolist()) for i, v in enumerate(self.model.centres)]
        parts += [("code", p, i, v.tolist()) for p, c in enumerate(self.model.codes) for i, v in enumerate(c)]
        parts += [("count", at, n, []) for at, n in self.counts.items()]
        parts += [(f"metric {self.model.metric}", 0, 0, []), (f"key {self.key}", 0, 0, []), ("probes", self.probes, self.depth, [])]
        self.spark.createDataFrame(parts, "kind string, i long, j long, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/model").orderBy("kind", "i", "j").collect()  # MOST_LISTS centres and counts, PARTS * 256 codes
        of = lambda kind: [r for r in rows if r.kind == kind]
        named = {r.kind.split(" ")[0]: r.kind.split(" ", 1)[1] for r in rows if " " in r.kind}
        centres = np.array([r.v for r in of("centre")])
        codes = np.array([r.v for r in of("code")]).reshape(-1, 256, len(of("code")[0].v))
        chosen = of("probes")[0]
        return cls(spark, path, Model(named["metric"], centres, codes), {r.i: r.j for r in of("count")}, named["key"], chosen.i, chosen.j)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, depth: int | None = None, vector: str = "embedding") -> DataFrame:
        """query_id, key, score, rank: for each query (rows with the key column) its k best other rows.

        depth: how many rows a query scores exactly; 0 is no bound, so with all lists probed the result is that of knn_join.
        """
        probes, depth = self.probes if probes is None else probes, self.depth if depth is None else depth
        if not self.counts:
            return self.spark.createDataFrame([], f"query_id long, `{self.key}` long, score double, rank int")
        measure, larger = METRICS[self.model.metric]
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(self.key).alias("query_id"), F.col(vector).cast("array<double>").alias("query"))
        probed = self._probe(asked, probes)
        load = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
        read = sorted(load.keys() & self.counts.keys())
        sizes = self.spark.createDataFrame([(at, -(-self.counts[at] // ROWS_AT_ONCE), -(-load[at] // QUERIES_AT_ONCE)) for at in read], "list int, n_rows int, n_queries int")
        rows = self.rows.where(F.col("list").isin(read))
        held = "codes" if depth else "embedding"  # without a depth the vectors themselves are compared
        cut = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        sides = [
            rows.select("list", self.key, held).join(F.broadcast(sizes), "list").select("list", self.key, held, cut(self.key, "n_rows").alias("piece"), every("n_queries").alias("block")),
            probed.join(F.broadcast(sizes), "list").select("list", "query_id", "query", every("n_rows").alias("piece"), cut("query_id", "n_queries").alias("block")),
        ]
        by = ["list", "piece", "block"]
        nearest = self._nearest(depth) if depth else self._exact(k)
        near = sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(nearest, f"query_id long, `{self.key}` long, list int, far double")
        near = top_per_group(near, depth or k, "query_id", F.asc("far"), F.col(self.key))
        vectors = rows.select("list", F.col(self.key).alias("_key"), F.col("embedding").alias("_v"))
        found = near.join(vectors, (near["list"] == vectors["list"]) & (near[self.key] == F.col("_key"))).join(asked, "query_id")
        scored = found.select("query_id", self.key, measure("query", "_v").alias("score"))
        order = F.desc("score") if larger else F.asc("score")
        best = top_per_group(scored, k, "query_id", order, F.col(self.key))
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, self.key)))

    def _probe(self, asked: DataFrame, probes: int) -> DataFrame:
        """asked with one row for each of its nearest lists."""
        held = self.spark.sparkContext.broadcast(astuple(self.model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(*held.value)
            for b in batches:
                if b.num_rows:
                    lists = model.nearest_lists(matrix(b.column(1)), probes)
                    again = np.repeat(np.arange(b.num_rows), lists.shape[1])
                    out = b.take(pa.array(again))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists.ravel().astype(np.int32))], names=["query_id", "query", "list"])

        return asked.mapInArrow(run, "query_id long, query array<double>, list int")

    def _nearest(self, depth: int):
        held, key = self.spark.sparkContext.broadcast(astuple(self.model)), self.key

        def run(at: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = [[], [], []]
            if rows.num_rows and asked.num_rows:
                model, ids = Model(*held.value), rows.column(key).to_numpy()
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
                parts = np.arange(codes.shape[1])
                for query, table in zip(asked.column("query_id").to_pylist(), model.tables(matrix(asked.column("query")), at[0].as_py())):
                    far = table[parts, codes].sum(1)
                    others = np.flatnonzero(ids != query)
                    if depth and len(others) > depth:
                        bar = np.partition(far[others], depth - 1)[depth - 1]
                        inside, edge = others[far[others] < bar], others[far[others] == bar]
                        others = np.concatenate([inside, edge[np.argsort(ids[edge], kind="stable")][: depth - len(inside)]])
                    for column, values in zip(out, ([query] * len(others), ids[others], far[others])):
                        column.extend(values)
            n = len(out[0])
            return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([at[0].as_py()] * n, pa.int32()), pa.array(out[2], pa.float64())], names=["query_id", key, "list", "far"])

        return run

    def _exact(self, k: int):
        """As _nearest, by the vectors: the k best rows of each query, so that no pair of the others leaves its task."""
        key, metric = self.key, self.model.metric

        def run(at: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
            ids, keys, far = (np.zeros(0, np.int64),) * 3
            if rows.num_rows and asked.num_rows:
                best = BestRows(k, asked.column("query_id").to_numpy(), matrix(asked.column("query")), metric)
                for start in range(0, rows.num_rows, POINTS_AT_ONCE):
                    part = rows.slice(start, POINTS_AT_ONCE)
                    best.add(part.column(key).to_numpy(), matrix(part.column("embedding"), best.q.shape[1]))
                ids, keys = best.rows()
                far = -best.scores[np.isfinite(best.scores)]
            return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([at[0].as_py()] * len(ids), pa.int32()), pa.array(far, pa.float64())], names=["query_id", key, "list", "far"])

        return run

    def tune(self, queries: DataFrame, k: int = 10, recall: float = 0.95, vector: str = "embedding") -> VectorIndex:
        """The index with the fewest probes, then the least depth, that find this share of the k true neighbours of a sample of queries."""
        some = queries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(self.key), self.key).limit(TUNING_QUERIES)
        rows = self.rows.select(self.key, F.col("embedding").alias(vector))
        true = {(r["query_id"], r[self.key]) for r in knn_join(some, rows, k, self.model.metric, self.key, vector).collect()}  # k a query
        if not true:
            return self
        ids = self.spark.createDataFrame(sorted({b for _, b in true}), "long").toDF(self.key)
        home = {r[self.key]: r["list"] for r in self.rows.join(F.broadcast(ids), self.key, "left_semi").select(self.key, "list").collect()}
        order = {r[self.key]: self.model.nearest_lists(np.array([r[vector]], float), len(self.model.centres))[0].tolist() for r in some.collect()}
        ranks = sorted(order[q].index(home[b]) + 1 for q, b in true)
        need = (1 + recall) / 2  # half of what may be missed is for the lists, half for the depth
        probes = ranks[int(np.ceil(need * len(ranks))) - 1]
        for times in DEPTHS:
            found = {(r["query_id"], r[self.key]) for r in self.search(some, k, probes, times * k, vector).collect()}
            if len(found & true) >= recall * len(true):
                break
        tuned = replace(self, probes=probes, depth=times * k)
        tuned.save()
        return tuned


def list_count(n: int) -> int:
    return max(1, min(MOST_LISTS, round(float(n) ** 0.5)))


def build(points: DataFrame, path: str, metric: str = "cosine", lists: int | None = None, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Indexes every row of points that has a vector; path: a folder that executors share."""
    if metric not in ("cosine", "euclid"):
        raise ValueError(f"no lists by {metric}: cosine or euclid")
    spark = points.sparkSession
    whole = points.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("embedding"))
    n = whole.count()
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < SAMPLE / max(n, 1) * (1 << 30)
    sample = whole.where(share).limit(2 * SAMPLE).select("embedding").toArrow()  # about SAMPLE rows
    x = matrix(sample.column(0)) if sample.num_rows else np.zeros((1, 1))
    model = train(x, min(list_count(n) if lists is None else lists, MOST_LISTS), metric)
    held = spark.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.slice(at, 4096)
                own_lists, codes = model.encode(matrix(own.column(1), model.centres.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), own.column(1), pa.array(own_lists.astype(np.int32))], names=[key, "codes", "embedding", "list"]
                )

    coded = whole.mapInArrow(run, f"`{key}` long, codes binary, embedding array<double>, list int")
    # A list's rows come together in few files, a large one's in several.
    coded.withColumn("_piece", F.pmod(F.xxhash64(key), F.lit(max(1, n // (ROWS_AT_ONCE * 20) + 1)))).repartition("list", "_piece").drop("_piece").sortWithinPartitions("list", key).write.mode(
        "overwrite"
    ).partitionBy("list").parquet(f"{path}/rows")
    index = VectorIndex(spark, path, model, {}, key)
    counts = {r["list"]: r["n"] for r in index.rows.groupBy("list").agg(F.count("*").alias("n")).collect()} if n else {}
    index = replace(index, counts=counts)
    index.save()
    return index
