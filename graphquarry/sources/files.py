"""File sources: text, markdown and DOCX by extension, in a registry that is open to more."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.functions import text as X

Extractor = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Extractor] = {}


def register(*extensions: str):
    """The last registration of an extension wins; case doesn't matter."""

    def put(f: Extractor) -> Extractor:
        for e in extensions:
            REGISTRY[e.lower().lstrip(".")] = f
        return f

    return put


def extractor_for(path: str) -> Extractor:
    extension = path.rsplit(".", 1)[-1].lower()
    if extension not in REGISTRY:
        raise KeyError(f"no extractor for .{extension}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[extension]


def load(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """path, content for files of one extension."""
    return extractor_for(extension or path)(spark, path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


@register("txt", "text", "log")
def text_file(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).withColumn("content", X.clean_text(F.col("content")))


@register("md", "markdown", "mdown")
def markdown_file(spark: SparkSession, path: str) -> DataFrame:
    raw = _whole(spark, path)
    return raw.withColumn("content", X.clean_markdown(X.clean_text(F.col("content")))).withColumn("metadata", X.markdown_metadata(F.col("content")))


def docx_parts(file) -> Iterator[str]:
    """The paragraphs of a document, tables included, with line ends between them. What was read is let go, so a paragraph is held at a time."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    blank, above, begun = {f"{w}tab": "\t", f"{w}br": "\n"}, [], False
    with zipfile.ZipFile(file) as z, z.open("word/document.xml") as xml:
        for event, x in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                above.append(x)
                continue
            above.pop()
            if any(a.tag == f"{w}p" for a in above):
                continue
            for p in x.iter(f"{w}p") if x.tag == f"{w}p" else ():
                yield "\n" * begun + "".join(n.text or "" if n.tag == f"{w}t" else blank.get(n.tag, "") for n in p.iter())
                begun = True
            if above:
                above[-1].remove(x)


def docx_text(data: bytes) -> str:
    return "".join(docx_parts(io.BytesIO(data)))


@register("docx")
def docx_file(spark: SparkSession, path: str) -> DataFrame:
    @F.pandas_udf(T.StringType())
    def read(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in files:
            yield s.map(docx_text)

    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", X.clean_document(read("content")).alias("content"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks, laid out by file so that one file's are read without the others."""
    chunks.repartition("file_id").sortWithinPartitions("file_id", "chunk_index").write.mode("append").parquet(path)


def file_chunks(spark: SparkSession, path: str, file_id) -> DataFrame:
    return spark.read.parquet(path).where(F.col("file_id") == file_id).orderBy("chunk_index")


def has_chunks(spark: SparkSession, path: str, file_id) -> bool:
    return not spark.read.parquet(path).where(F.col("file_id") == file_id).isEmpty()


def count_chunks(chunks: DataFrame) -> DataFrame:
    """file_id, n_chunks."""
    return chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"))


def without_file(chunks: DataFrame, file_ids: DataFrame) -> DataFrame:
    return chunks.join(file_ids.select("file_id"), "file_id", "left_anti")


def file_statistics(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size")
    )


def type_histogram(df: DataFrame, name: str, separator: str = ".") -> DataFrame:
    """extension (lower case, after the last separator) and n, most frequent first."""
    extension = F.lower(F.substring_index(F.col(name), separator, -1))
    return df.groupBy(extension.alias("extension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension")


@register("pdf")
def pdf_file(spark: SparkSession, path: str) -> DataFrame:
    """Needs pypdf on the executors."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("PDF files need pypdf, which isn't installed") from e

    @F.pandas_udf(T.StringType())
    def read(pdfs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pypdf

        for s in pdfs:
            yield s.map(lambda b: "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(b)).pages))

    return spark.read.format("binaryFile").load(path).select("path", X.clean_pdf(read("content")).alias("content"))
