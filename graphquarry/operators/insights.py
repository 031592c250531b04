"""Statistics, flags and chart hints of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegralType, MapType, NumericType, StructType


def pooled_statistics(df: DataFrame) -> DataFrame:
    """count, sum, avg, min, max over all cells of numeric columns."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if not numbers:
        cells = df.select(F.lit(None).cast("double").alias("x")).limit(0)
    else:
        cells = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in numbers])).alias("x")).where("x IS NOT NULL")
    return cells.agg(F.count("x").alias("count"), F.sum("x").alias("sum"), F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"))


def insights(df: DataFrame) -> DataFrame:
    """The pooled statistics with outlier flags: max above twice, min above 0 and below half of the average."""
    high = F.coalesce(F.col("max") > 2 * F.col("avg"), F.lit(False))
    low = F.coalesce((F.col("min") > 0) & (F.col("min") < 0.5 * F.col("avg")), F.lit(False))
    return pooled_statistics(df).withColumn("high_outlier", high).withColumn("low_outlier", low)


#: Strings longer than this are shown cut to three less and an ellipsis.
SHOWN_CHARS = 50


def labelled_value(df: DataFrame, name: str) -> Column:
    """A value with its type as an example shows it: null, true (boolean), 3 (integer), 1.5 (float), a string, a date-like string, or JSON (array)."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    quoted = lambda s: F.concat(F.lit("'"), s, F.lit("'"))
    if isinstance(kind, BooleanType):
        text = F.concat(c.cast("string"), F.lit(" (boolean)"))
    elif isinstance(kind, IntegralType):
        text = F.concat(c.cast("string"), F.lit(" (integer)"))
    elif isinstance(kind, NumericType):
        text = F.concat(c.cast("string"), F.lit(" (float)"))
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        text = F.concat(F.to_json(c), F.lit(" (array)"))
    else:
        s = c.cast("string")
        dated = F.concat(quoted(s), F.lit(" (string date - compare as: property < "), quoted(s), F.lit(")"))
        shown = F.when(F.char_length(s) > SHOWN_CHARS, F.concat(F.substring(s, 1, SHOWN_CHARS - 3), F.lit("..."))).otherwise(s)
        text = F.when(F.rlike(s, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}")), dated).otherwise(F.concat(quoted(shown), F.lit(" (string)")))
    return F.coalesce(text, F.lit("null"))


def labelled(df: DataFrame) -> DataFrame:
    """All values with their types."""
    return df.select(*[labelled_value(df, c).alias(c) for c in df.columns])


def as_table(df: DataFrame, limit: int = 100) -> DataFrame:
    """headers, rows: one row that a chat shows as a table, of at most `limit` rows of the result, in its order."""
    cells = df.limit(limit).select(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("cells"))
    numbered = cells.withColumn("_at", F.monotonically_increasing_id())
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_at", "cells"))), lambda r: r["cells"])
    return numbered.agg(F.array(*map(F.lit, df.columns)).alias("headers"), rows.alias("rows"))


def suggest_charts(columns: list[str], n_rows: int, aggregate: bool = False, has_relationship: bool = False) -> list[str]:
    low = [c.lower() for c in columns]
    out = []
    if "count" in low:
        out.append("number")
    if has_relationship:
        out.append("graph")
    if n_rows > 1 and len(columns) > 2:
        out.append("table")
    if aggregate and n_rows > 1:
        out.append("bar")
    if any(w in c for c in low for w in ("date", "time", "created", "updated", "month", "year")):
        out.append("line")
    return out or ["table"]
