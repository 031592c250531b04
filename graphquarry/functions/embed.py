"""Embedding: a protocol for embedders and a local one that hashes words, without any network."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    size: int

    def embed(self, texts: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """texts with a vector column."""


class HashEmbedder:
    """Word counts in hashed places, of length 1. Equal texts get equal vectors, texts that share words near ones."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        counted = HashingTF(numFeatures=self.size, inputCol="_words", outputCol="_tf").transform(texts.withColumn("_words", words))
        v = vector_to_array("_tf")
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        unit = F.transform("_v", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0).cast("float"))
        return counted.withColumn("_v", v).withColumn("_norm", norm.alias("_norm")).withColumn(out, unit).drop("_words", "_tf", "_v", "_norm")


def embed_distinct(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """df with vectors, each distinct text embedded once. Vectors find their rows by the texts' SHA-256, so no text travels with one."""
    digest = F.coalesce(F.unhex(F.sha2(F.col(text), 256)), F.lit(b""))  # a null is no empty text
    once = embedder.embed(df.select(text).distinct(), text, out).select(digest.alias("_digest"), out)
    return df.withColumn("_digest", digest).join(once, "_digest", "left").drop("_digest")
