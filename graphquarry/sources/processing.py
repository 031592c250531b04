"""Folders of files processed step by step: a ledger of what was done, chunks with vectors, an error for each file that fails.

A run reads every file's bytes once for a hash and compares it with the ledger: unchanged files that were done are skipped (unless forced).
The others are extracted by type, cut by their type's chunk size, embedded and stored. Files are read by parts, so they may be larger than
a task's memory, from file systems that pyarrow opens. A file that can't be read, has no
known type or no text becomes a row with its error and stops no other. Ledger and chunks are committed together, so
a run that dies leaves both as they were and is simply run again. A changed file's old chunks go; so do those of one that fails now.
"""

from __future__ import annotations

import hashlib
import re
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from graphquarry.functions import streams as S
from graphquarry.functions import text as X
from graphquarry.sources import files, scratch
from graphquarry.sources.store import Manifest
from graphquarry.streaming.changelog import ChangeTable, commit_together, sweep

LEDGER = "name string, hash string, status string, error string, n_chunks long, text_length long, _seq long"
CHUNKS = "name string, chunk_index int, total_chunks int, content string, start_position long, end_position long, embedding array<float>, _seq long"
CUT = [
    ("name", pa.string()), ("hash", pa.string()), ("skip", pa.bool_()), ("known_chunks", pa.int64()), ("error", pa.string()), ("text_length", pa.int64()),
    ("total_chunks", pa.int32()), ("chunk_index", pa.int32()), ("content", pa.string()), ("start_position", pa.int64()), ("end_position", pa.int64()),
]
#: Extension -> what it is read as, and the chunk sizes' name.
TEXTS = {"txt": "txt", "text": "txt", "log": "txt", "md": "md", "markdown": "md", "mdown": "md"}
BINARY = {"docx": files.docx_parts}
#: Rows that Python hands over at once.
BATCH = 500


def write_files(df: DataFrame, folder: str, part: str | None = None) -> None:
    """Writes rows (name, content) as files of a folder that all executors share, over those of the same names.

    part: a column that orders the rows of a name, whose contents then follow each other in its file, each but the first with its bytes
    `before` in front. A file is written as its parts come, so no task holds a whole one.
    """
    Manifest(df.sparkSession, folder).files.mkdirs()

    def run(rows: Iterator[Row]) -> None:
        store, root = pafs.FileSystem.from_uri(folder)
        last, out = None, None
        try:
            for name, content, before in rows:
                if out is not None and part is not None and name == last:
                    out.write(before)
                else:
                    if out is not None:
                        out.close()
                    last, out = name, store.open_output_stream(f"{root}/{name}")
                out.write(content)
        finally:
            if out is not None:
                out.close()

    rows = df if part is None else df.repartition("name").sortWithinPartitions("name", part)
    # Rows go to Python in batches of some bytes; Arrow's are of some rows, whatever these hold.
    rows.select("name", "content", "before" if part else F.lit(b"").alias("before")).foreachPartition(run)


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder as Hadoop names it. Local names may hold any character."""
    return (pafs.LocalFileSystem(), re.sub("^file:/+", "/", folder)) if folder.startswith("file:") else pafs.FileSystem.from_uri(folder)


def digest(stream) -> str:
    found = hashlib.sha256()
    while data := stream.read(S.STEP):
        found.update(data)
    return found.hexdigest()


def chunk_rows(text: Callable[[], Iterable[str]], kind: str) -> Iterator[dict]:
    """A row a chunk of a text that can be read again, or one for a text without any."""
    n, shown = 0, False
    for p in text():
        n, shown = n + len(p), shown or p.strip(" \t\n\r\x0b\x00") != ""
    cut = lambda: S.semantic_chunks(text, n, *X.CHUNK_SIZES[kind])
    total, start = sum(1 for _ in cut()) if shown else 0, 0
    if not total:
        yield {"text_length": n if shown else None, "total_chunks": 0}
        return
    for i, c in enumerate(cut()):
        yield {"text_length": n, "total_chunks": total, "chunk_index": i, "content": c, "start_position": start, "end_position": start + len(c)}
        start += len(c)


def file_rows(store: pafs.FileSystem, root: str, name: str) -> Iterator[dict]:
    """chunk_rows of a file, or a row with its error. It is read again for each pass, part by part."""
    path, extension = f"{root}/{name}", name.rpartition(".")[2].lower() if "." in name else ""

    def text() -> Iterator[str]:
        with store.open_input_stream(path) as f:
            yield from S.decoded(f)

    if extension in TEXTS:
        kind = TEXTS[extension]
        try:
            yield from chunk_rows({"txt": lambda: S.clean_text(text()), "md": lambda: S.clean_markdown(text)}[kind], kind)
        except UnicodeDecodeError:
            yield {"error": "not UTF-8"}
    elif extension in BINARY:
        with tempfile.SpooledTemporaryFile(S.STEP) as f:  # its parser seeks, which not all stores allow
            with store.open_input_stream(path) as given:
                shutil.copyfileobj(given, f, S.STEP)
            try:
                yield from chunk_rows(lambda: S.clean_document(BINARY[extension](f)), extension)
            except Exception as e:  # whatever a broken file makes its reader raise is that file's error
                yield {"error": f"{type(e).__name__}: {e}"}
    else:
        yield {"error": f"unsupported type: {extension}"}


class FileStore:
    """root: where ledger and chunks live. embed(df, column) -> df with `embedding`."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame, str], DataFrame], buckets: int = 8):
        self.spark, self.embed, self.manifest = spark, embed, Manifest(spark, root)
        table = lambda name, ddl, *key: ChangeTable(spark, root, name, spark.createDataFrame([], ddl).schema, key, ("_seq",), buckets)
        self._ledger, self._chunks = table("ledger", LEDGER, "name"), table("chunks", CHUNKS, "name", "chunk_index")

    def ledger(self) -> DataFrame:
        return self._ledger.read(self.manifest.load()[1].get("ledger", {})).drop("_seq")

    def chunks(self) -> DataFrame:
        return self._chunks.read(self.manifest.load()[1].get("chunks", {})).drop("_seq")

    def process(self, folder: str, force: bool = False) -> DataFrame:
        """name, status (done, skipped, failed), n_chunks, error of every file below the folder; names are relative to it."""
        # One row a chunk, and one for a file without any: whole texts are neither stored, shuffled nor held.
        cut = scratch.materialise(self._cut(folder, force), "files-chunks")
        chunks = cut.where("chunk_index IS NOT NULL").select("name", "chunk_index", "total_chunks", "content", "start_position", "end_position")
        files_ = cut.where("NOT skip AND coalesce(chunk_index, 0) = 0")
        error = F.coalesce("error", F.when(F.col("chunk_index").isNull(), "no text"))
        status = F.when(error.isNull(), "done").otherwise("failed")
        rows = scratch.materialise(files_.select("name", "hash", status.alias("status"), error.alias("error"), F.coalesce("total_chunks", F.lit(0)).cast("long").alias("n_chunks"), "text_length"), "files-rows")

        def put_chunks(states: dict, seq: int) -> None:
            old = self._chunks.read(states.get("chunks", {})).select("name", "chunk_index").join(rows.select("name"), "name", "left_semi")
            gone = old.join(chunks.select("name", "chunk_index"), ["name", "chunk_index"], "left_anti")
            stamp = lambda df: df.withColumn("_seq", F.lit(seq).cast("long"))
            states["chunks"] = self._chunks.stage(states.get("chunks", {}), stamp(self.embed(chunks, "content").withColumn("embedding", F.col("embedding").cast("array<float>"))), stamp(gone))

        def put_ledger(states: dict, seq: int) -> None:
            states["ledger"] = self._ledger.stage(states.get("ledger", {}), rows.withColumn("_seq", F.lit(seq).cast("long")))

        commit_together(self.manifest, [("chunks", put_chunks), ("ledger", put_ledger)])
        skipped = cut.where("skip").select("name", F.lit("skipped").alias("status"), F.col("known_chunks").alias("n_chunks"), F.lit(None).cast("string").alias("error"))
        return skipped.unionByName(rows.select("name", "status", "n_chunks", "error"))

    def forget(self, names: DataFrame) -> None:
        """Takes files (column name) out of ledger and chunks: for those that were deleted."""

        def step(table: ChangeTable, *keys: str) -> Callable[[dict, int], None]:
            def run(states: dict, seq: int) -> None:
                gone = table.read(states.get(table.name, {})).select(*keys).join(names.select("name"), "name", "left_semi")
                states[table.name] = table.stage(states.get(table.name, {}), None, gone.withColumn("_seq", F.lit(seq).cast("long")))

            return run

        commit_together(self.manifest, [("chunks", step(self._chunks, "name", "chunk_index")), ("ledger", step(self._ledger, "name"))])

    def sweep(self, keep: int = 2) -> None:
        sweep(self.manifest, keep)

    def _found(self, folder: str) -> DataFrame:
        """name of all files below the folder. Their bytes aren't read."""
        at = re.sub("^file:/+", "file:/", self.manifest.files.qualified(folder))
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return raw.select(F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:/'), {len(at) + 2})").alias("name"))

    def _cut(self, folder: str, force: bool) -> DataFrame:
        """CUT: a row for a file to skip, or a row a chunk, or one without a chunk.

        A file is hashed, cleaned and cut by one task, since all three are sequential, but by parts: what the task holds doesn't grow with the file.
        """
        done = F.when((F.col("status") == "done") & F.lit(not force), F.col("hash"))
        known = self.ledger().select("name", done.alias("known_hash"), F.col("n_chunks").alias("known_chunks"))
        at, schema = self.manifest.files.qualified(folder), pa.schema(CUT)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            store, root = opened(at)
            for b in batches:
                for file in b.to_pylist():
                    with store.open_input_stream(f"{root}/{file['name']}") as f:
                        same = {"name": file["name"], "hash": digest(f), "skip": False}
                    if same["hash"] == file["known_hash"]:
                        yield same | {"skip": True, "known_chunks": file["known_chunks"]}
                    else:
                        yield from (same | row for row in file_rows(store, root, file["name"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = rows(batches)
            while some := list(islice(found, BATCH)):
                yield pa.RecordBatch.from_pylist(some, schema)

        # Few files of any size each: dealt over more tasks than there are cores, so that no core gets many large ones.
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        return self._found(folder).join(known, "name", "left").repartition(tasks, "name").mapInArrow(run, from_arrow_schema(schema))
