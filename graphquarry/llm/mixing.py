"""Mixing sources to target weights (DataFrame operations only).

Each document gets a hash-random key. Within a source the documents stand in the order of their keys; a
distributed prefix sum of their sizes along that order tells which of them fit the source's budget. A
budget above the source's size repeats it in whole epochs and cuts the last one.

The prefix sum never sorts a source in one task: keys are evenly spread, so fixed key ranges of the same
width hold about the same number of rows, whichever source is the hot one. Ranges are summed first, and spans of
ranges; the sums are accumulated along each source, and only then are rows accumulated inside their range. Only the
summary of one row a source is ever in one task.

The key is a hash of doc_id and text, so rows without an id, or with a repeated one, are spread like all others. Rows alike in id,
source and text are counted first and planned in blocks: they are interchangeable, and no task gets all of them.

Defined cases: a null text has size 0; null is a source of its own, after all others; rows that are alike take from the mix in
any order; an empty table gives an empty mix; further columns are ignored by mix() and kept by take().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm.common import join_hot, materialise, null_safe_key, quoted, text_or_empty, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Rows that are alike are planned in blocks of so many.
COPIES_AT_ONCE = 10_000
ROWS_PER_RANGE = 500
RANGES_PER_SPAN = 500


def mix_key(doc_id: str | Column = "doc_id", seed: int = 7) -> Column:
    """32 evenly distributed hex digits."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("null"))))


def block_key(seed: int = 7) -> Column:
    """The key of a block of rows that are alike: from id, text and block number, so that no id and no text is hot in it."""
    return mix_key(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_md5"), F.col("_block").cast("string")), seed)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target: shares by weight, none above most times its source.

    Sharing again what is above a limit, until nothing is, raises one water level over all sources that
    are below their limits. With the sources in the order of limit / weight, the level that leaves the
    first k at their limits is (total - their limits) / (weights of the rest), and the first k whose
    level is within the limit of the next source is the answer. One row a source, so the global windows
    run over a summary that the number of sources bounds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    total = F.sum("source_size").over(all_rows)
    a = sizes.withColumn("_weight", weight).withColumn("_limit", most * F.col("source_size"))
    b = a.withColumn("_ratio", F.col("_limit") / F.col("_weight")).withColumn("_total", total)
    c = b.withColumn(
        "_before", F.coalesce(F.sum("_limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_rest", F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    d = c.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(all_rows)["_level"]
    e = d.withColumn("_water", level)
    return e.select(
        "source",
        "source_size",
        F.least(F.col("_limit").cast("double"), F.col("_water") * F.col("_weight")).alias("target"),
    )


def prefix_sums(rows: DataFrame, group: list[str], key: str, value: str, tie: list[str]) -> DataFrame:
    """rows with `before`: the sum of value over the rows of the group that stand earlier by key, tie.

    key holds hex digits of an even hash. Its ranges get narrower as the table grows, so that one range
    of a group has about ROWS_PER_RANGE rows even where a single group holds them all; RANGES_PER_SPAN ranges are
    a span. Spans are added up along each group, ranges within their span, rows within their range.
    """
    n = max(1, -(-rows.count() // ROWS_PER_RANGE))
    unit = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("_range", F.floor(unit * n / F.lit(float(1 << 32))).cast("long"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda value, *by: F.coalesce(F.sum(value).over(earlier(*by)), F.lit(0))
    own = [F.col(g).alias(f"_s_{g}") for g in group]
    named = [f"_s_{g}" for g in group]
    ranges = dealt.groupBy(*own, F.col("_range").alias("_s_range")).agg(F.sum(value).alias("_sum")).withColumn("_span", F.floor(F.col("_s_range") / RANGES_PER_SPAN))
    spans = ranges.groupBy(*[F.col(g).alias(f"_{g}") for g in named], F.col("_span").alias("_in_span")).agg(F.sum("_sum").alias("_span_sum"))
    begun = spans.withColumn("_begun", so_far("_span_sum", *[f"_{g}" for g in named], "_in_span"))
    within = ranges.withColumn("_within", so_far("_sum", *named, "_span", "_s_range"))
    both = F.col("_span") == F.col("_in_span")
    for g in named:
        both = both & F.col(g).eqNullSafe(F.col(f"_{g}"))
    starts = within.join(begun, both).select(*named, "_s_range", (F.col("_begun") + F.col("_within")).alias("_start"))
    same = F.col("_range") == F.col("_s_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    inside = Window.partitionBy(*group, "_range").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(starts, same).withColumn(
        "before", (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")
    )
    return summed.select(*rows.columns, "before")


ALIKE = ("doc_id", "source", "size", "text_md5")


def sized(docs: DataFrame, *own: str) -> DataFrame:
    """ALIKE, and further columns."""
    text = text_or_empty("text")
    return docs.select("doc_id", "source", word_count(text).alias("size"), F.md5(text).alias("text_md5"), *own)


def planned(rows: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    """A row for each block of at most COPIES_AT_ONCE rows that are alike: ALIKE, source_size, target, n, epochs, n_more.

    Each of the block's n rows is taken `epochs` times, and the first n_more of them once more. Rows alike are counted before
    they are shuffled, so however many there are, no task gets them all.
    """
    alike = rows.groupBy(*ALIKE).agg(F.count("*").alias("_n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES_AT_ONCE)))
    blocks = alike.withColumn("_block", block).withColumn("n", F.least(F.lit(COPIES_AT_ONCE), F.col("_n") - F.col("_block") * COPIES_AT_ONCE).cast("long"))
    held = materialise(
        blocks.select(*ALIKE, "n", (F.col("n") * F.col("size")).alias("_weight"), block_key(seed).alias("_key"), null_safe_key(F.col("source")).alias("_group")), "mix-sizes"
    )
    sources = targets(held.groupBy("source").agg(F.sum("_weight").alias("source_size")), weights, most)
    ranked = prefix_sums(held, ["_group"], "_key", "_weight", ["doc_id", "size"])
    plan = sources.select(null_safe_key(F.col("source")).alias("_g"), "source_size", "target")
    # One row a source; where the sources are so many that it isn't small, Spark joins by sorting and splits hot ones.
    joined = ranked.join(plan, F.col("_group") == F.col("_g"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # Row i of the block stands at before + i * size; it is in if its middle is within what the last epoch may take.
    left = 2 * (F.col("target") - F.col("epochs") * F.col("source_size")) - 2 * F.col("before") - F.col("size")
    more = F.when((F.col("size") > 0) & (left >= 0), F.least(F.col("n"), F.floor(left / (2 * F.col("size"))) + 1)).otherwise(0).cast("long")
    return joined.withColumn("epochs", epochs).select(*ALIKE, "source_size", "target", "n", "epochs", more.alias("n_more"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often each document is in the mix.

    A source takes floor(target / source_size) whole epochs. In the last, partial one a document is in
    if its middle is within the budget left, so a source misses its target by half a document at most.
    """
    each = planned(sized(docs), weights, most, seed).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = each.withColumn("copies", F.col("epochs") + F.when(F.col("_i") <= F.col("n_more"), 1).otherwise(0))
    return copies.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it.

    Each row travels as one struct, so no column of docs can clash with the operator's own. Rows that are alike take the
    same, but where the cut goes through them: then as many as the mix says take one more, drawn by an even hash of their row numbers.
    """
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    numbered = materialise(docs.select(whole.alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    rows = sized(numbered.select("_doc.doc_id", "_doc.source", "_doc.text", "_doc", "_row"), "_doc", "_row")
    blocks = planned(rows, weights, most, seed)
    groups = materialise(blocks.groupBy(*ALIKE).agg(F.sum("n").alias("_n"), F.first("epochs").alias("_epochs"), F.sum("n_more").alias("_more")), "mix-plan")
    taken = groups.where((F.col("_epochs") > 0) | (F.col("_more") > 0)).withColumn("_group", F.md5(F.to_json(F.struct(*ALIKE))))
    total = groups.agg(F.sum("_n")).first()[0] or 0
    # The join weighs keys by _w; _n comes along as a value.
    known = join_hot(rows, taken.withColumn("_w", F.col("_n")), list(ALIKE), "_w", total, "inner").where(F.col("_group").isNotNull())
    cut = (F.col("_more") > 0) & (F.col("_more") < F.col("_n"))
    some = materialise(known.where(cut).select("_group", "_row", "_more", F.md5(F.col("_row").cast("string")).alias("_key"), F.lit(1).cast("long").alias("_one")), "mix-cut")
    drawn = prefix_sums(some, ["_group"], "_key", "_one", ["_row"]).where(F.col("before") < F.col("_more")).select(F.col("_row").alias("_drawn"))
    final = known.join(drawn, F.col("_row") == F.col("_drawn"), "left")
    more = F.when(cut, F.col("_drawn").isNotNull()).otherwise(F.col("_more") > 0).cast("long")
    kept = final.withColumn("_copies", F.col("_epochs") + more).where(F.col("_copies") > 0)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")
