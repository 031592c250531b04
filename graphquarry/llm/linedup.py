"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

A run is a table with one row for each line key, bucketed and sorted by the key's hash: how many documents hold
it, and the largest and smallest of their doc_ids. Each batch of documents is aggregated to the same form and
merge-joined with the runs, which are neither shuffled nor sorted for it. Keys that no run has are new (the anti-join);
for the others the runs tell how many earlier documents hold them. Then the batch adds its own run to level 0, and a level
that has `fanout` runs is merged into one run of the next, so a key is rewritten a logarithmic number of times.

What the contract asks for needs counts over all documents, and the largest holder stays. So a key that reaches
`min_docs` within a batch decides on two sides: the lines of this batch go, unless they are the largest holder's; and so do the lines
of the earlier holders that were still waiting, which are the largest and the smallest at most, as long as min_docs is 3 or less.
The order of batches doesn't matter. The number of batches is fixed rather than grown with the table: every
batch reads all runs, so reading grows with the number of batches.

Lines travel as hashes with their places in the text, never as text; what goes is gathered as places for each document.
Keys are compared by a 128-bit hash. Defined cases: a null or empty text is one empty line; short keys
are never dropped; a key repeated in a document counts it once; rows that repeat a doc_id count as
documents of their own but share its fate; a null doc_id ranks below all others; texts of any number of lines
are read whole, in time that grows with their lines; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm.common import WHITE, ascii_lower, drop_folder, join_hot, materialise, new_folder, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 2
BATCHES = 4
KEY = ["h1", "h2"]
#: A doc_id with its rank: null below all others.
HOLDER = "struct<known:boolean,id:bigint>"
STATE = ["n_docs", "top", "low"]


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """struct(h1, h2) of a line's key; null if the key is too short to count."""
    bare = F.btrim(line, F.lit(WHITE))
    key = ascii_lower(bare)
    pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    return F.when(F.char_length(bare) >= min_chars, pair)


def line_facts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, h1, h2, place, first: each long line; first marks one of the equal lines of a document."""
    hashed = docs.select(
        "doc_id",
        F.xxhash64(text_or_empty("text")).alias("text_hash"),
        F.transform(line_array(text_or_empty("text")), lambda x, i: F.struct(line_hash(x, min_chars).alias("h"), i.alias("i"))).alias("_l"),
    )
    long = F.filter("_l", lambda x: x["h"].isNotNull())
    sorted_ = hashed.select("doc_id", "text_hash", F.array_sort(F.transform(long, lambda x: F.struct(x["h"]["h1"].alias("h1"), x["h"]["h2"].alias("h2"), x["i"].alias("place")))).alias("_s"))
    before = lambda i: F.get("_s", i - 1)
    marked = F.transform(
        "_s",
        lambda x, i: F.struct(
            x["h1"].alias("h1"), x["h2"].alias("h2"), x["place"].alias("place"),
            (~F.coalesce((before(i)["h1"] == x["h1"]) & (before(i)["h2"] == x["h2"]), F.lit(False))).alias("first"),
        ),
    )
    return sorted_.select("doc_id", "text_hash", F.explode(marked).alias("_f")).select("doc_id", "text_hash", "_f.*")


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within, a scan of buckets of one file each counts as sorted, so that a merge join doesn't sort them again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


@dataclass
class RunStore:
    """The levels of runs below a shared folder; the driver holds their names only."""

    spark: SparkSession
    root: str
    fanout: int = FANOUT
    min_docs: int = MIN_DOCS
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self):
        if not 2 <= self.min_docs <= 3:
            raise ValueError("min_docs is 2 or 3: a key keeps its largest and smallest holder, no others")
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        """rows are dealt by the hash of KEY into as many partitions as there are buckets, so each bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        how = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").format("parquet")
        with sorted_buckets(self.spark):
            how.saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_folder(f"{self.root}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def met(self, facts: DataFrame) -> DataFrame:
        """The batch's keys with their own state and the state over all runs: one merge join for each run."""
        holder = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").cast("long").alias("id")).cast(HOLDER)
        own = facts.groupBy(*KEY).agg(
            F.count(F.when(F.col("first"), 1)).alias("n_docs"), F.max(holder).alias("top"), F.min(holder).alias("low"), F.count("*").alias("n_lines")
        )
        names = self.runs()
        for i, name in enumerate(names):
            run = self.spark.table(name).select(*KEY, *[F.col(c).alias(f"{c}_{i}") for c in STATE])
            own = own.join(run.hint("merge"), KEY, "left")
        over = lambda f, c: f(*[F.col(f"{c}_{i}") for i in range(len(names))]) if len(names) > 1 else F.col(f"{c}_0") if names else F.lit(None).cast(HOLDER)
        n = sum((F.coalesce(f"n_docs_{i}", F.lit(0)) for i in range(len(names))), F.lit(0)).cast("long")
        before = [n.alias("n_before"), over(F.greatest, "top").alias("top_before"), over(F.least, "low").alias("low_before")]
        return own.select(*KEY, *STATE, "n_lines", *before)

    def add(self, facts: DataFrame) -> DataFrame:
        """Takes in one batch and returns its decisions: keys that have reached min_docs, with the holder that stays (top), the
        batch's lines of the key, and the earlier holders whose lines go now."""
        name = self._write(self.met(facts))
        state = self.spark.table(name).where(F.col("n_before") + F.col("n_docs") >= self.min_docs)
        top = F.greatest("top", "top_before")
        waiting = F.when(F.col("n_before") >= self.min_docs, F.array("top_before")).when(F.col("n_before") > 0, F.array("top_before", "low_before"))
        late = F.filter(F.array_distinct(F.coalesce(waiting, F.array().cast(f"array<{HOLDER}>"))), lambda x: x != top)
        decided = materialise(state.select(*KEY, "n_lines", top.alias("top"), late.alias("late")), "line-decisions")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._compact()
        return decided

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for other in full[1:]:
                both = self._write(self._merged(merged, other))
                self._drop(merged)
                self._drop(other)
                merged = both
            level += 1
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(merged)

    def _merged(self, a: str, b: str) -> DataFrame:
        """Two runs in one: a full merge join of tables with the same buckets and order."""
        x = self.spark.table(a).select(*KEY, *[F.col(c).alias(f"{c}_0") for c in STATE])
        y = self.spark.table(b).select(*KEY, *[F.col(c).alias(f"{c}_1") for c in STATE])
        n = (F.coalesce("n_docs_0", F.lit(0)) + F.coalesce("n_docs_1", F.lit(0))).cast("long")
        return x.join(y.hint("merge"), KEY, "full").select(*KEY, n.alias("n_docs"), F.greatest("top_0", "top_1").alias("top"), F.least("low_0", "low_1").alias("low"))

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = []


def take_in(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
    """The facts of docs, written once by batch; the decisions of all batches; the run store that has taken them in."""
    spark, root = docs.sparkSession, new_folder(docs.sparkSession, "line-runs")
    dealt = line_facts(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int"))
    dealt.write.partitionBy("batch").parquet(f"{root}/facts")
    facts = spark.read.schema(dealt.schema).parquet(f"{root}/facts")
    store, decided = RunStore(spark, root, fanout, min_docs), []
    for b in range(batches):
        decided.append(store.add(facts.where(F.col("batch") == b)).withColumn("batch", F.lit(b)))
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    return facts, out, store


def dropped(facts: DataFrame, decided: DataFrame) -> DataFrame:
    """doc_id, text_hash, places (of the lines that go, in the text)."""
    own = decided.select("batch", *KEY, "n_lines", "top")
    now = join_hot(facts, own, ["batch", *KEY], "n_lines", facts.count(), "inner").where(~F.col("doc_id").eqNullSafe(F.col("top.id")))
    late = decided.select(*KEY, F.explode("late").alias("_late")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("_late.id").alias("_id")).distinct()
    then = facts.join(late, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    places = ["doc_id", "text_hash", "place"]
    return now.select(*places).union(then.select(*places)).groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs' doc_id with text after dropping, n_lines (before) and n_dropped; one row for each row of docs."""
    facts, decided, store = take_in(docs, batches, FANOUT, min_chars, min_docs)
    goes = materialise(dropped(facts, decided), "line-drops")
    store.close()
    drop_folder(f"{store.root}/facts")
    found = goes.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    text = text_or_empty("text")
    here = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h"))
    joined = here.join(found, (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    split = joined.select("doc_id", "text", line_array(F.col("text")).alias("_lines"), "places")
    # Two uses of _lines keep Catalyst from splitting the text anew for each line.
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("places"))
    stay = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return split.select(
        "doc_id",
        F.when(F.col("places").isNull(), F.col("text")).otherwise(stay).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"),
    )
