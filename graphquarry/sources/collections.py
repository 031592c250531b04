"""Named vector collections as catalog tables: vec_id, embedding, and payload columns."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.operators.vectors import METRICS, knn, upsert_points


@dataclass(frozen=True)
class CollectionInfo:
    name: str
    size: int
    distance: str
    points: int


class Collections:
    """A collection is a view of one table; a write makes a new table and points the view at it in one step.

    So the name always stands for a whole collection, before, during and after a write, and a writer that dies leaves the old one
    in place. The table before the current one stays for readers that began with it; older ones go.
    """

    def __init__(self, spark: SparkSession, prefix: str = "vec_"):
        self.spark, self.prefix = spark, prefix

    def _table(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII):
            raise ValueError(f"no identifier: {name!r}")
        return f"{self.prefix}{name}".lower()

    def _versions(self, name: str) -> list[str]:
        """The tables of a collection, oldest first, the current one included."""
        begin = f"{self._table(name)}__"
        return sorted(t.name for t in self.spark.catalog.listTables() if t.name.startswith(begin))

    def _put(self, name: str, df: DataFrame, size: int, distance: str) -> None:
        old = self._versions(name)
        number = int(old[-1].split("__")[-1][:8]) + 1 if old else 0
        new = f"{self._table(name)}__{number:08d}_{uuid.uuid4().hex[:8]}"
        df.write.saveAsTable(new)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._table(name)} TBLPROPERTIES ('size' = '{int(size)}', 'distance' = '{distance}') AS SELECT * FROM {new}")
        for table in old[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def create(self, name: str, size: int, distance: str = "cosine", payload: str = "") -> bool:
        """False if it exists. payload: further columns as DDL."""
        if distance.lower() not in METRICS:
            raise ValueError(f"unknown distance {distance}")
        if self.exists(name):
            return False
        schema = "vec_id long, embedding array<float>" + (f", {payload}" if payload else "")
        self._put(name, self.spark.createDataFrame([], schema), size, distance.lower())
        return True

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._table(name))

    def delete(self, name: str) -> None:
        tables = self._versions(name)
        self.spark.sql(f"DROP VIEW IF EXISTS {self._table(name)}")
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def names(self) -> list[str]:
        return sorted(t.name[len(self.prefix) :] for t in self.spark.catalog.listTables() if t.name.startswith(self.prefix) and t.tableType == "VIEW")

    def points(self, name: str) -> DataFrame:
        return self.spark.read.table(self._table(name))

    def info(self, name: str) -> CollectionInfo:
        props = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._table(name)}").collect()}
        return CollectionInfo(name, int(props["size"]), props["distance"], self.points(name).count())

    def clear(self, name: str) -> None:
        """An empty collection of the same size, distance and payload."""
        old = self.info(name)
        self._put(name, self.spark.createDataFrame([], self.points(name).schema), old.size, old.distance)

    def upsert(self, name: str, points: DataFrame, distance: str = "cosine") -> None:
        """Insert or replace by vec_id; a new collection takes the first vector's length."""
        if not self.exists(name):
            first = points.select(F.size("embedding")).first()
            self._put(name, points, first[0] if first else 0, distance)
            return
        old = self.info(name)
        self._put(name, upsert_points(self.points(name), points), old.size, old.distance)

    def remove(self, name: str, ids: DataFrame) -> None:
        old = self.info(name)
        self._put(name, self.points(name).join(ids.select("vec_id"), "vec_id", "left_anti"), old.size, old.distance)

    def search(self, name: str, query: DataFrame, k: int, where: Column | None = None, threshold: float = 0) -> DataFrame:
        return knn(self.points(name), query, k, self.info(name).distance, where, threshold)
