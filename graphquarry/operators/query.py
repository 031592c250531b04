"""Running plans: row limits, counts, pages, output formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from graphquarry.operators.ingest import latest
from graphquarry.sources import scratch

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def execute(df: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """df with a row limit unless the caller turns it off."""
    return df if limit is None else df.limit(max(1, min(limit, MAX_LIMIT)))


def execute_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    current_page: int
    per_page: int
    last_page: int
    from_row: int
    to_row: int
    total: int


#: Pages that end beyond this row are read from ranges; up to it each task keeps its first rows and one merges them.
DEEP = 10_000


class Ranges:
    """A result in its order, cut into ranges that are written out, with the number of each range's first row.

    Any page is read from the ranges that hold its rows and from no other; ranks of all rows come without a sort in one task.
    The order has to be total. What the driver holds is a count a range. Where keys are frequent, a total order still splits them.
    """

    def __init__(self, df: DataFrame, *order: Column | str, ranges: int | None = None):
        spark = df.sparkSession
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.order, self.columns = order, df.columns
        dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
        path = scratch.folder(spark, "ranges")
        dealt.write.partitionBy("_range").parquet(path)
        schema = StructType([*df.schema.fields]).add("_range", IntegerType())
        self.rows = spark.read.schema(schema).parquet(path)
        self.counts = {r["_range"]: r["n"] for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
        self.first, self.total = {}, 0
        for at in sorted(self.counts):
            self.first[at] = self.total
            self.total += self.counts[at]

    def slice(self, offset: int, n: int) -> DataFrame:
        """Rows offset to offset + n - 1, in order."""
        held = [at for at, first in self.first.items() if first < offset + n and first + self.counts[at] > offset]
        own = self.rows.where(F.col("_range").isin(held)).select(*[f"`{c}`" for c in self.columns])
        return own.orderBy(*self.order).offset(offset - self.first[held[0]] if held else 0).limit(n)

    def ranked(self, name: str = "rank") -> DataFrame:
        """All rows with their numbers, from 1."""
        starts = self.rows.sparkSession.createDataFrame(list(self.first.items()), "_at int, _first long")
        inside = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order))
        numbered = self.rows.join(F.broadcast(starts), F.col("_range") == F.col("_at")).withColumn(name, F.col("_first") + inside)
        return numbered.select(*[f"`{c}`" for c in self.columns], name)


def page_rows(df: DataFrame, page: int, per_page: int, *order: Column | str) -> DataFrame:
    """One page; the order has to be total for pages to be stable."""
    per_page, page = max(1, min(per_page, MAX_LIMIT)), max(1, page)
    offset = (page - 1) * per_page
    if offset + per_page > DEEP:
        return Ranges(df, *order).slice(offset, per_page)
    return df.orderBy(*order).offset(offset).limit(per_page)


def paginate(df: DataFrame, page: int, per_page: int, *order: Column | str) -> Page:
    """The first row's number is given even for an empty result."""
    per_page, page = max(1, min(per_page, MAX_LIMIT)), max(1, page)
    total = df.count()
    offset = (page - 1) * per_page
    rows = page_rows(df, page, per_page, *order)
    return Page(rows, page, per_page, max(1, -(-total // per_page)), offset + 1, min(offset + per_page, total), total)


def explain(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()


def is_valid(build) -> bool:
    """Whether a plan can be analysed; nothing is run."""
    try:
        build().schema
        return True
    except Exception:
        return False


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def graph_nodes(df: DataFrame, label: str, key: str, sequence: str | None = None) -> DataFrame:
    """id, label, properties: each node once. Of several rows with its id the last one counts, by the column sequence."""
    if sequence is not None:
        df = latest(df, key, sequence)
    elif df.columns:
        # Without a sequence rows of one id are taken to be equal.
        df = df.dropDuplicates([key])
    props = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(F.col(key).cast("string").alias("id"), F.lit(label).alias("label"), props.alias("properties"))


def graph_relationships(edges: DataFrame, type_: str) -> DataFrame:
    """type, start, end: as they come, repeats included."""
    return edges.select(F.lit(type_).alias("type"), F.col("src_id").cast("string").alias("start"), F.col("dst_id").cast("string").alias("end"))


def best_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group; an aggregate, so that a large group isn't sorted."""
    return top_per_group(df, 1, group, *order)


def top_per_group(df: DataFrame, n: int, group: str, *order: Column) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def example_entities(df: DataFrame, n: int, group: str, key: str) -> DataFrame:
    """n rows of each group with the most properties that aren't null."""
    known = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return top_per_group(df.withColumn("n_known", known), n, group, F.desc("n_known"), F.col(key))


def history_last(messages: DataFrame, n: int) -> DataFrame:
    return top_per_group(messages, n, "conv_id", F.desc("turn"))


def history_context(messages: DataFrame, n: int = 10, cut: int = 200) -> DataFrame:
    """conv_id, context: the n messages before the current (last) one, long assistant ones cut, joined by lines."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") > 1) & (F.col("_rank") <= n + 1))
    long = (F.col("role") == "assistant") & (F.char_length("text") > cut)
    text = F.when(long, F.concat(F.substring("text", 1, cut), F.lit("..."))).otherwise(F.col("text"))
    lines = recent.select("conv_id", "turn", F.concat(F.col("role"), F.lit(": "), text).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


def flatten(df: DataFrame, column: str) -> DataFrame:
    """The fields of a node's struct as columns."""
    return df.select(f"{column}.*")


def preview(df: DataFrame, n: int = 10) -> tuple[DataFrame, int]:
    """The first n rows and how many are left."""
    return df.limit(n), max(0, df.count() - n)


def run_sql(read, tables: list[str], spark, sql: str, **params) -> DataFrame:
    """SQL over tables, with named parameters that are bound, never pasted in."""
    for t in tables:
        read(t).createOrReplaceTempView(t)
    check_read_only(spark, sql)
    return spark.sql(sql, args=params)


def check_read_only(spark, sql: str) -> None:
    """Raises where the parsed statement is a command: only queries pass, whatever words they hold."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names = {plan.getClass().getSimpleName()} | {x.getClass().getSimpleName() for x in _children(plan)}
    wrong = sorted(n for n in names if any(w in n for w in ("Command", "Insert", "Create", "Drop", "Delete", "Update", "Merge", "Alter", "Set", "Truncate")) and n != "SetOperation")
    if wrong:
        raise ValueError(f"not a query: {', '.join(wrong)}")


def _children(plan):
    kids = plan.children()
    for i in range(kids.size()):
        yield kids.apply(i)
        yield from _children(kids.apply(i))


def search_metadata(rows: DataFrame, criteria: dict, newest: str = "uploaded_at", after=None, before=None, key: str = "id", limit: int = 10) -> DataFrame:
    """The newest rows that meet all criteria: a value, a list of values, or (low, high) with None for an open end.

    after and before bound the column newest; all bounds are inclusive, and nulls meet no criterion.
    """
    for column, want in [*criteria.items(), (newest, (after, before))]:
        if isinstance(want, tuple):
            low, high = want
            rows = rows if low is None else rows.where(F.col(column) >= F.lit(low))
            rows = rows if high is None else rows.where(F.col(column) <= F.lit(high))
        else:
            rows = rows.where(F.col(column).isin(*want) if isinstance(want, list) else F.col(column) == F.lit(want))
    return rows.orderBy(F.desc(newest), key).limit(limit)
