"""Text functions: cleaning, markdown, redaction, token estimates, chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (chunk size, overlap) of a file type.
CHUNK_SIZES = {"pdf": (1200, 200), "txt": (1000, 150), "md": (1500, 300), "docx": (1200, 200), "html": (1500, 300), "default": (1000, 200)}


def normalize_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def clean_text(text: Column) -> Column:
    """Line ends, control characters, ends."""
    return F.trim(F.regexp_replace(normalize_lines(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def clean_document(text: Column) -> Column:
    """clean_text, and runs of blanks and of empty lines."""
    blanks = F.regexp_replace(clean_text(text), r"[ \t]+", " ")
    return F.regexp_replace(blanks, r"\n{3,}", "\n\n")


def clean_pdf(text: Column) -> Column:
    """clean_document without soft hyphens and with words joined that a line end had cut."""
    joined = F.regexp_replace(F.regexp_replace(text, "­", ""), r"(\w)-\s*\n\s*(\w)", "$1-$2")
    return clean_document(joined)


def clean_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<!--[\s\S]*?-->", ""), r"\n{3,}", "\n\n")


# What markdown is stripped of, in this order.
MARKDOWN = (
    (r"```[\s\S]*?```", ""),
    (r"`[^`]+`", ""),
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(\*\*|__)(.*?)\1", "$2"),
    (r"(\*|_)(.*?)\1", "$2"),
    (r"(?m)^(-{3,}|\*{3,}|_{3,})$", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"(?m)^>\s+", ""),
    (r"\n{3,}", "\n\n"),
)
# Secrets that are blotted out, in this order.
SECRETS = (
    (r"""(?i)(["']?api[_-]?key["']?\s*[:=]\s*["']?)([a-zA-Z0-9_\-]{20,})""", "$1***REDACTED***"),
    (r"Bearer\s+([a-zA-Z0-9_\-\.]{20,})", "Bearer ***REDACTED***"),
    (r"sk-[a-zA-Z0-9]{48}", "sk-***REDACTED***"),
    (r"sk-ant-[a-zA-Z0-9\-_]{95,}", "sk-ant-***REDACTED***"),
    (r"""(?i)(["']?token["']?\s*[:=]\s*["']?)([a-zA-Z0-9_\-]{20,})""", "$1***REDACTED***"),
    (r"""(?i)(["']?password["']?\s*[:=]\s*["']?)([^"'\s]{3,})""", "$1***REDACTED***"),
    (r"""(?i)(["']?passwd["']?\s*[:=]\s*["']?)([^"'\s]{3,})""", "$1***REDACTED***"),
    (r"""(?i)(["']?pwd["']?\s*[:=]\s*["']?)([^"'\s]{3,})""", "$1***REDACTED***"),
    (r"""(?i)(["']?db[_-]?password["']?\s*[:=]\s*["']?)([^"'\s]{3,})""", "$1***REDACTED***"),
    (r"AKIA[0-9A-Z]{16}", "AKIA***REDACTED***"),
    (r"([A-Za-z0-9+\/]{40})", "***REDACTED_AWS_SECRET***"),
    (r"Authorization:\s*Basic\s+([A-Za-z0-9+\/=]+)", "Authorization: Basic ***REDACTED***"),
    (r"\/\/([^:]+):([^@]+)@", "//***REDACTED***:***REDACTED***@"),
)


def _chain(text: Column, steps) -> Column:
    for find, put in steps:
        text = F.regexp_replace(text, find, put)
    return text


def strip_markdown(text: Column) -> Column:
    return _chain(text, MARKDOWN)


# What a text holds, in lower case, if a pattern above can match it; the pattern without a keyword stands for itself.
SECRET_SIGNS = ("key", "bearer", "sk-", "token", "passw", "pwd", "akia", "authorization", "//")


def redact(text: Column) -> Column:
    """The patterns run over the few texts that show a sign of a secret, the signs over all."""
    low = F.lower(text)
    suspect = reduce(lambda a, b: a | b, [low.contains(sign) for sign in SECRET_SIGNS]) | F.rlike(text, F.lit("[A-Za-z0-9+/]{40}"))
    return F.when(suspect, _chain(text, SECRETS)).otherwise(text)


def markdown_metadata(text: Column) -> Column:
    """struct(n_headers, n_links, n_images, n_code_blocks, front_matter)."""
    front = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(front, "\n"), lambda x: F.rlike(x, F.lit(r"^\w+:\s*.+$")))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1), F.btrim(F.regexp_extract(x, r"^\w+:\s*(.+)$", 1), F.lit("\"'")))
    return F.struct(
        F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s+\S")).alias("n_headers"),
        F.regexp_count(text, F.lit(r"(?<!!)\[[^\]]+\]\([^\)]+\)")).alias("n_links"),
        F.regexp_count(text, F.lit(r"!\[[^\]]*\]\([^\)]+\)")).alias("n_images"),
        F.regexp_count(text, F.lit(r"```[\s\S]*?```")).alias("n_code_blocks"),
        F.map_from_entries(F.transform(lines, entry)).alias("front_matter"),
    )


def text_statistics(text: Column) -> list[Column]:
    """n_chars, n_lines, n_words (ASCII)."""
    return [
        F.char_length(text).cast("long").alias("n_chars"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.size(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda x: x != "")).cast("long").alias("n_words"),
    ]


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    """A quarter of the characters, rounded up; a fifth more for what looks like JSON."""
    n = F.ceil(F.char_length(text) / F.lit(chars_per_token))
    return F.when(F.substring(text, 1, 1).isin("{", "["), F.ceil(n * F.lit(1.2))).otherwise(n).cast("long")


def char_chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """df with chunk_index and content: windows that start every size - overlap characters."""
    step = size - min(overlap, size - 1)
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    windows = df.select("*", F.posexplode(starts).alias("chunk_index", "_start"))
    out = windows.withColumn("content", F.substring(F.col(text), F.col("_start") + 1, F.lit(size))).drop("_start")
    return out.where(F.trim("content") != "")


def semantic_chunks(text: str | None, size: int = 1000, overlap: int = 200, paragraphs: bool = True, sentences: bool = True) -> list[str]:
    """Whole paragraphs, else whole sentences, else windows of characters, packed into chunks of at most size."""
    text = re.sub("\r\n?", "\n", text or "")
    if not text.strip():
        return []
    if len(text) <= size:
        return [text]
    for wanted, cut, glue in ((paragraphs, r"\n\s*\n", "\n\n"), (sentences, r"(?<=[.!?])\s+", " ")):
        packed = _pack([u for u in re.split(cut, text) if u], size, overlap, glue) if wanted else None
        if packed:
            return packed
    step = size - min(overlap, size - 1)
    return [c for i in range(0, len(text), step) if (c := text[i : i + size]).strip()]


def _pack(units: list[str], size: int, overlap: int, glue: str) -> list[str] | None:
    """None if a unit is larger than a chunk."""
    if any(len(u) > size for u in units):
        return None
    chunks = [glue.join(units[first:end]) for first, end in _places([len(u) for u in units], size, overlap, len(glue))]
    return [c for c in chunks if c.strip()]


def _places(lengths: list[int], size: int, overlap: int, glue: int) -> list[tuple[int, int]]:
    """First and end unit of each chunk. A chunk starts with the last units of the one before it, up to overlap.

    Cuts are places in the cumulative lengths, each unit counted with a glue. A chunk that starts with
    repeated units counts one glue less, and holds one new unit at least.
    """
    at = [0, *accumulate(n + glue for n in lengths)]
    places, first, fresh = [], 0, 0
    while fresh < len(lengths):
        end = max(fresh + 1, bisect_right(at, at[first] + size + glue * (first < fresh)) - 1)
        places.append((first, end))
        first, fresh = max(first, bisect_left(at, at[end] - glue - overlap)), end
    return places


#: What Python's \s and strip() take for white space, as a class of Java's patterns.
WHITE = r"[\t-\r\x1C-\x20\x85\xA0  -     　]"
WHOLE, PARAGRAPHS, SENTENCES, WINDOWS = range(4)


def _chunk_places(how: int, lengths: list[int], blanks: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """First part and number of parts of each chunk that isn't blank. blanks: with how many blanks each part begins."""
    shown = lambda i: blanks[i] < lengths[i]
    if how == WHOLE:
        return [(0, 1)] if shown(0) else []
    if how == WINDOWS:
        step = size - min(overlap, size - 1)
        n = -(-size // step)
        near = lambda i: (j for j in range(i, min(i + n, len(lengths))) if shown(j) and (j - i) * step + blanks[j] < size)
        return [(i, n) for i in range(len(lengths)) if next(near(i), None) is not None]
    places = _places(lengths, size, overlap, 2 if how == PARAGRAPHS else 1)
    return [(first, end - first) for first, end in places if any(shown(i) for i in range(first, end))]


def exploded_chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """df without text, with total_chunks, chunk_index, content: a row for each string of semantic_chunks, one with nulls where there is none.

    Spark splits the texts and puts the chunks together. Only the packing is sequential; it runs in a pandas UDF that gets
    the lengths of the parts, so what Python holds doesn't grow with the texts.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([[x for place in _chunk_places(h, n.tolist(), b.tolist(), size, overlap) for x in place] for h, n, b in zip(*columns)], dtype=object)

    kept, step = [F.col(c) for c in df.columns if c != text], size - min(overlap, size - 1)
    t, how, parts = F.col("_t"), F.col("_how"), F.col("_parts")
    units = lambda cut: F.filter(F.split(t, cut), lambda u: u != "")
    longest = lambda us: F.array_max(F.transform(us, lambda u: F.char_length(u)))
    out = df.select(*kept, normalize_lines(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    out = out.withColumn("_paragraphs", F.when(F.char_length(t) > size, units(f"\n{WHITE}*\n")))
    # A null is a short text; no units are those of blanks, which windows find to be blank.
    out = out.withColumn("_how", F.when(F.col("_paragraphs").isNull(), WHOLE).when(longest(F.col("_paragraphs")) <= size, PARAGRAPHS).otherwise(SENTENCES))
    out = out.withColumn("_parts", F.when(how == PARAGRAPHS, F.col("_paragraphs")).when(how == SENTENCES, units(f"(?<=[.!?]){WHITE}+")).otherwise(F.array(t))).drop("_paragraphs")
    out = out.withColumn("_how", F.when((how == SENTENCES) & ~F.coalesce(longest(parts) <= size, F.lit(False)), WINDOWS).otherwise(how))
    # Windows are joined from pieces of a step each, so that none is searched for from the start of its text.
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    out = out.select(*kept, "_how", F.when(how == WINDOWS, pieces).otherwise(parts).alias("_parts"))
    blanks = F.transform("_parts", lambda u: F.char_length(F.regexp_extract(u, f"^{WHITE}*", 0)))
    out = out.withColumn("_places", places("_how", F.transform("_parts", lambda u: F.char_length(u)), blanks))
    out = out.withColumn("total_chunks", (F.size("_places") / 2).cast("int"))
    numbers = F.when(F.size("_places") > 0, F.sequence(F.lit(0), F.size("_places") - 2, F.lit(2)))
    # Outer, since Spark would else repeat all of the above in a filter on the array.
    out = out.select(*kept, "_how", "_parts", "_places", "total_chunks", F.posexplode_outer(numbers).alias("chunk_index", "_i"))
    own = F.slice("_parts", F.get("_places", F.col("_i")) + 1, F.get("_places", F.col("_i") + 1))
    content = F.when(how == PARAGRAPHS, F.array_join(own, "\n\n")).when(how == SENTENCES, F.array_join(own, " "))
    content = content.when(how == WINDOWS, F.substring(F.array_join(own, ""), 1, size)).otherwise(own[0])
    return out.select(*kept, "total_chunks", "chunk_index", content.alias("content"))


def chunk_table(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, total_chunks, chunk_index, content by semantic_chunks."""
    return exploded_chunks(df.select(key, text), text, size, overlap).where(F.col("chunk_index").isNotNull())
