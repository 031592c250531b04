"""Tables kept up to date by changes: a base in hash buckets, runs of changes over it, merged when read.

A batch of changes (rows, or keys to delete) writes one run: the newest change of each of its keys, laid out by bucket and
sorted by key. Deleted keys are tombstones. Nothing else is rewritten; only a bucket that has gathered MOST_RUNS runs is merged
with them to a new base, and no other bucket with it. Readers merge what is
pending in touched buckets by one aggregate and read the base of all others as it stands.

The newest change of a key counts, by the version columns; of changes of equal version a deletion. Tombstones stay in
the base, so that an older row which comes late doesn't come back; purge() ends that for old ones. What belongs to a table is
said by a state, a plain value in a manifest: staging a run changes files that nobody reads yet, and committing the manifest puts
it in place. Files of earlier states stay until sweep(), for readers that began before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructType

from graphquarry.sources.store import Manifest

BUCKETS = 16
MOST_RUNS = 4
GONE = "_deleted"


@dataclass(frozen=True)
class ChangeTable:
    spark: SparkSession
    root: str
    name: str
    schema: StructType
    key: tuple[str, ...]
    version: tuple[str, ...]
    buckets: int = BUCKETS
    most_runs: int = MOST_RUNS

    @property
    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add(GONE, BooleanType())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _newest(self, df: DataFrame) -> DataFrame:
        """The newest row of each key, tombstones included; an aggregate that combines before it shuffles."""
        row = F.max_by(F.struct(*df.columns), F.struct(*self.version, F.coalesce(F.col(GONE), F.lit(False))))
        return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.key]).agg(row.alias("_row")).select("_row.*")

    def _write_newest(self, df: DataFrame, path: str) -> str:
        """Rows are shuffled once, to their bucket, and both told apart and written there."""
        by = df.withColumn("_bucket", self._bucket()).repartition("_bucket")
        row = F.max_by(F.struct(*df.columns), F.struct(*self.version, F.coalesce(F.col(GONE), F.lit(False))))
        keys = [f"_k_{k}" for k in self.key]
        newest = by.groupBy("_bucket", *[F.col(k).alias(f"_k_{k}") for k in self.key]).agg(row.alias("_row")).select("_bucket", *keys, "_row.*")
        # By the keys as they were grouped: rows that the aggregate has sorted aren't sorted once more.
        newest.sortWithinPartitions("_bucket", *keys).drop(*keys).write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return path

    def _write(self, rows: DataFrame, path: str) -> str:
        by = rows.withColumn("_bucket", self._bucket())
        by.repartition("_bucket").sortWithinPartitions("_bucket", *self.key).write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return path

    def stage(self, state: dict, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> dict:
        """The state with a run of these changes, written but not in place. deletes: the key and version columns."""
        parts = []
        if upserts is not None:
            parts.append(upserts.select(*self.schema.names).withColumn(GONE, F.lit(False)))
        if deletes is not None:
            others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (*self.key, *self.version) else F.col(f.name) for f in self.schema.fields]
            parts.append(deletes.select(*others).withColumn(GONE, F.lit(True)))
        run = self._write_newest(reduce(DataFrame.unionByName, parts), f"{self.name}/run-{uuid.uuid4().hex}")
        touched = self._touched(run)
        pending = {str(b): [*state.get("runs", {}).get(str(b), []), run] for b in touched}
        return self._merged(state | {"runs": {**state.get("runs", {}), **pending}})

    def _touched(self, path: str) -> list[int]:
        """The buckets that a run has rows of."""
        names = Manifest(self.spark, self.root).files.names(path)
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("_bucket="))

    def _merged(self, state: dict) -> dict:
        """The state with full buckets merged to a new base each."""
        full = [b for b, runs in state["runs"].items() if len(runs) >= self.most_runs]
        return self.compact(state, full) if full else state

    def compact(self, state: dict, buckets: list[str] | None = None) -> dict:
        """The state with the runs of these buckets (or all) merged into their base."""
        chosen = [b for b, runs in state.get("runs", {}).items() if runs and (buckets is None or b in buckets)]
        if not chosen:
            return state
        new = self._write_newest(self._parts(state, chosen), f"{self.name}/base-{uuid.uuid4().hex}")
        return state | {"base": {**state.get("base", {}), **{b: new for b in chosen}}, "runs": {b: r for b, r in state["runs"].items() if b not in chosen}}

    def _load(self, path: str, buckets: list[str]) -> DataFrame:
        at = [f"{self.root}/{path}/_bucket={b}" for b in buckets]
        return self.spark.read.schema(self._stored).parquet(*at)

    def _parts(self, state: dict, buckets: list[str]) -> DataFrame:
        """Base rows and pending changes of some buckets: only their folders are read."""
        by_path: dict[str, list[str]] = {}
        for b in buckets:
            base = [state["base"][b]] if b in state.get("base", {}) else []
            for path in [*base, *state.get("runs", {}).get(b, [])]:
                by_path.setdefault(path, []).append(b)
        parts = [self._load(path, own) for path, own in by_path.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._stored)

    def changes(self, state: dict) -> DataFrame:
        """The newest row of each key, deleted ones included."""
        # A bucket of one file set, base or run, holds each key once already.
        parts = {b: (b in state.get("base", {})) + len(state.get("runs", {}).get(b, [])) for b in {**state.get("base", {}), **state.get("runs", {})}}
        pending, quiet = [b for b, n in parts.items() if n > 1], [b for b, n in parts.items() if n == 1]
        merged, still = self._newest(self._parts(state, pending)) if pending else None, self._parts(state, quiet) if quiet else None
        both = [x for x in (merged, still) if x is not None]
        return reduce(DataFrame.unionByName, both) if both else self.spark.createDataFrame([], self._stored)

    def read(self, state: dict) -> DataFrame:
        return self.changes(state).where(~F.col(GONE)).drop(GONE)

    def purge(self, state: dict, before: Column) -> dict:
        """The state without the tombstones for which `before` holds; all buckets are rewritten."""
        left = self.changes(state).where(~(F.col(GONE) & before))
        new = self._write(left, f"{self.name}/base-{uuid.uuid4().hex}")
        return {"base": {str(b): new for b in self._touched(new)}, "runs": {}}


def used(state: dict) -> set[str]:
    return {*state.get("base", {}).values(), *(r for runs in state.get("runs", {}).values() for r in runs)}


class StepFailed(RuntimeError):
    def __init__(self, step: str, cause: Exception):
        super().__init__(f"{step}: {cause}")
        self.step, self.cause = step, cause


def commit_together(manifest: Manifest, steps: list[tuple[str, Callable[[dict, int], None]]]) -> int:
    """Runs named steps on a copy of the manifest's states (each gets it and the new version) and commits what they staged at once.

    After an error nothing is committed, and what was staged is deleted.
    """
    version, now = manifest.load()
    states, name = dict(now), "manifest"
    try:
        for name, step in steps:
            step(states, version + 1)
        name = "manifest"
        return manifest.commit(states, version)
    except Exception as e:
        before = set().union(*map(used, now.values()))
        for path in set().union(*map(used, states.values())) - before:
            manifest.files.drop(path)
        raise StepFailed(name, e) from e


def sweep(manifest: Manifest, keep: int = 2) -> None:
    """Deletes the files that none of the last `keep` versions of several tables reads."""
    last = manifest.version()
    kept = set().union(*(used(s) for v in range(max(1, last - keep + 1), last + 1) for s in manifest.load(v)[1].values()))
    for folder in [f for f in manifest.files.names() if f != "manifest"]:
        for name in manifest.files.names(folder):
            if f"{folder}/{name}" not in kept:
                manifest.files.drop(f"{folder}/{name}")
    manifest.forget(keep)


class ChangeFeed:
    """One table that follows a stream of changes; a batch that is run again changes nothing."""

    def __init__(self, table: ChangeTable, operation: Callable[[], Column] | None = None):
        """operation: whether a row of the feed deletes its key; without it none does."""
        self.table, self.operation = table, operation
        self.manifest = Manifest(table.spark, table.root)

    def read(self) -> DataFrame:
        return self.table.read(self.manifest.load()[1].get("state", {}))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        version, now = self.manifest.load()
        if batch_id <= now.get("batch", -1):
            return
        held = batch.persist()
        try:
            gone = self.operation() if self.operation else F.lit(False)
            state = self.table.stage(now.get("state", {}), held.where(~gone), held.where(gone) if self.operation else None)
        finally:
            held.unpersist()
        self.manifest.commit({"batch": batch_id, "state": state}, version)

    def follow(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over what is there now, then ends; a later call goes on from the checkpoint."""
        return source.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def sweep(self, keep: int = 2) -> None:
        """Deletes the files that none of the last `keep` versions reads."""
        last = self.manifest.version()
        kept = set().union(*(used(self.manifest.load(v)[1].get("state", {})) for v in range(max(1, last - keep + 1), last + 1)))
        for name in self.manifest.files.names(self.table.name):
            if f"{self.table.name}/{name}" not in kept:
                self.manifest.files.drop(f"{self.table.name}/{name}")
        self.manifest.forget(keep)
