"""Change feeds without deletions: latest-wins upserts from a stream, safe to run a batch twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphquarry.streaming.changelog import ChangeFeed, ChangeTable


class LatestTable(ChangeFeed):
    """The newest row of each key, below a folder.

    The state is in the folder alone, so a restarted driver goes on. A batch writes its own rows, and of older states one
    stays, for readers and for a batch that is run again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, version: tuple[str, ...]):
        super().__init__(ChangeTable(spark, path, "rows", schema, (key,), version))
        self.schema = schema

    def versions(self) -> list[int]:
        """The batches whose states are still there."""
        names = [n for n in self.manifest.files.names("manifest") if n.endswith(".json")]
        return [self.manifest.load(int(n.split(".")[0]))[1]["batch"] for n in names]

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        self.apply(batch, batch_id)
        self.sweep()


def stream_upsert(source: DataFrame, table: LatestTable, checkpoint: str) -> StreamingQuery:
    """Runs over what is there now, then ends; a later call goes on from the checkpoint."""
    return source.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
