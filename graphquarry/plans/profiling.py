"""What the rows say of a schema: statistics, candidate keys, inclusions between columns, foreign keys.

Statistics of all columns of a table come from one scan, distinct counts as sketches. A key is proposed by its
sketch and then counted exactly. For inclusions every table is scanned once more: its values are exploded with their column's number,
made distinct before they are shuffled (so a value that fills a column moves once a task), and grouped by value to
the set of columns that hold it. There are few different sets; pairs of columns are counted over them, never over values.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegralType, MapType, NumericType, StringType, StructType, VariantType

from graphquarry.plans.discovery import discover, singular
from graphquarry.plans.model import EntityDef

#: A sketch may be off by so much before a column is no candidate any more.
SKETCH_SLACK = 0.85
#: Strings of this many characters on average, and of some words, are texts whatever their name.
TEXT_CHARS, TEXT_WORDS = 40, 5


def plain(df: DataFrame) -> list[str]:
    """Columns whose values can be compared and counted."""
    nested = (ArrayType, MapType, StructType, VariantType, BooleanType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def column_statistics(df: DataFrame) -> DataFrame:
    """column_name, type, n_rows, n_null, n_distinct (a sketch), avg_chars, avg_words of strings: one scan for all columns."""
    out = []
    for f in df.schema.fields:
        c, text = F.col(f"`{f.name}`"), isinstance(f.dataType, StringType)
        known = f.name in plain(df)
        out.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count("*").alias("n_rows"),
                F.count(F.when(c.isNull(), 1)).alias("n_null"),
                (F.approx_count_distinct(c) if known else F.lit(None).cast("long")).alias("n_distinct"),
                (F.avg(F.char_length(c)) if text else F.lit(None).cast("double")).alias("avg_chars"),
                (F.avg(F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))) if text else F.lit(None).cast("double")).alias("avg_words"),
            ).alias(f"s{len(out)}")
        )
    row = df.agg(*out)
    return row.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(out))])).alias("s")).select("s.*")


def is_text(avg_chars: Column, avg_words: Column) -> Column:
    return F.coalesce((avg_chars >= TEXT_CHARS) & (avg_words >= TEXT_WORDS), F.lit(False))


def candidate_keys(df: DataFrame, width: int = 2) -> list[tuple[str, ...]]:
    """Minimal sets of up to `width` columns without nulls that tell all rows apart; each is counted exactly."""
    names = plain(df)
    wide = lambda cs: F.approx_count_distinct(F.struct(*[F.col(f"`{c}`") for c in cs]))
    first = df.agg(F.count("*"), *[F.count(f"`{c}`") for c in names], *[F.approx_count_distinct(f"`{c}`") for c in names]).first()
    n, full, distinct = first[0], dict(zip(names, first[1 : 1 + len(names)])), dict(zip(names, first[1 + len(names) :]))
    names = [c for c in names if full[c] == n and n]
    found: list[tuple[str, ...]] = []
    for k in range(1, width + 1):
        sets = [s for s in combinations(names, k) if not any(set(f) <= set(s) for f in found)]
        # Columns with too few values can't tell the rows apart together.
        sets = [s for s in sets if reduce(lambda a, c: a * distinct[c], s, 1) >= SKETCH_SLACK**k * n]
        if k > 1 and sets:
            near = df.agg(*[wide(s) for s in sets]).first()
            sets = [s for s, d in zip(sets, near) if d >= SKETCH_SLACK * n]
        for s in sets:
            twice = df.groupBy(*[F.col(f"`{c}`") for c in s]).count().where("count > 1")
            if twice.isEmpty():
                found.append(s)
    return found


def value_overlaps(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, other_table, other_column, n_values, n_common: distinct values, and those that the other column has too.

    Whole-number columns meet whole-number columns and strings strings; pairs without a common value have no row.
    """
    columns, parts = [], []
    for name, df in tables.items():
        own = []
        for f in df.schema.fields:
            if isinstance(f.dataType, (IntegralType, StringType)):
                kind = "n" if isinstance(f.dataType, NumericType) else "s"
                own.append(F.struct(F.lit(len(columns)).alias("at"), F.concat(F.lit(kind), F.col(f"`{f.name}`").cast("string")).alias("value")))
                columns.append((len(columns), name, f.name))
        if own:
            parts.append(df.select(F.explode(F.array(*own)).alias("x")).select("x.*").where("value IS NOT NULL").distinct())
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame(columns, "at int, table_name string, column_name string")
    sets = reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.sort_array(F.collect_set("at")).alias("held")).groupBy("held").agg(F.count("*").alias("n"))
    pairs = sets.select(F.explode("held").alias("a"), "held", "n").select("a", F.explode("held").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n_common"))
    own = pairs.where("a = b").select(F.col("a").alias("own"), F.col("n_common").alias("n_values"))
    other = names.select(F.col("at").alias("b"), F.col("table_name").alias("other_table"), F.col("column_name").alias("other_column"))
    return (
        pairs.where("a <> b").join(own, F.col("a") == F.col("own")).join(names, F.col("a") == F.col("at")).join(other, "b")
        .select("table_name", "column_name", "other_table", "other_column", "n_values", "n_common")
    )


def names_agree(column: str, other_table: str, other: str) -> bool:
    """x_custkey and c_custkey, or customer_id and customers.id."""
    stem = lambda c: c.split("_", 1)[-1]
    return ("_" in column and "_" in other and stem(column) == stem(other)) or (other == "id" and column == f"{singular(other_table)}_id")


def foreign_keys(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(table, column, table, key): all values of the column are among those of another table's key, and their names agree.

    Whole inclusion alone isn't enough where keys are numbers from 1 on: small numbers are included in everything. One row a pair of
    columns comes to the driver.
    """
    keys = {name: [k[0] for k in candidate_keys(df, 1)] for name, df in tables.items()}
    whole = value_overlaps(tables).where("n_common = n_values AND table_name <> other_table").collect()
    return sorted((r.table_name, r.column_name, r.other_table, r.other_column) for r in whole if r.other_column in keys[r.other_table] and names_agree(r.column_name, r.other_table, r.other_column))


def discover_entities(tables: dict[str, DataFrame]) -> list[EntityDef]:
    """Entities with keys and relationships as the rows have them; a table without a key of one column goes by its first column."""
    schemas, found = {n: df.schema for n, df in tables.items()}, foreign_keys(tables)
    out = []
    for name, df in tables.items():
        keys = candidate_keys(df, 1)
        links = [(c, other, key) for t, c, other, key in found if t == name]
        own = next((k[0] for k in keys if k[0] not in {c for c, _, _ in links}), None)
        out.append(discover(name, schemas, links, own or df.columns[0]))
    return out
