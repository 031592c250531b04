"""Matching questions to entities and scopes: by exact text, by words, by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.operators.query import top_per_group
from graphquarry.operators.vectors import cosine

# Words that carry no meaning for a match.
STOP_WORDS = (
    "the a an is are was were be been being "
    "have has had do does did will would could should "
    "may might must shall can need dare ought used "
    "to of in for on with at by from as into "
    "through during before after above below between "
    "and but or nor so yet both either neither "
    "not only own same than too very just "
    "how many much what which who whom this that "
    "these those am there all any each every show "
    "list find get display"
).split()
#: Two words in common, or one where an example has no more than so many.
FEW_WORDS = 3


def words(text: Column, min_length: int = 3) -> Column:
    """Lower-case words of at least min_length letters that are no stop words, repeats included. A-Z, digits and _ make words."""
    parts = F.split(F.lower(text), "[^a-z0-9_]+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(parts, lambda w: (F.char_length(w) >= min_length) & ~F.array_contains(stop, w))


def keyword_match(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """question_id, example_id, overlap, score: how many of an example's words the question has.

    Two have to be, or one where the example has FEW_WORDS or fewer; of a concept (column kind = 'concept', if there is one) always two.
    score is the fixed one of this fallback. Rows meet over their rarer words only: two texts that share two words share one
    that isn't the commonest of either, so each text leaves its commonest word out, where it needs two; the pairs
    that meet are then counted on whole texts. A word that fills the questions is joined split, by AQE.
    """
    concept = F.col("kind") == "concept" if "kind" in examples.columns else F.lit(False)
    e = examples.select("example_id", words(F.col("example")).alias("ws"), concept.alias("concept")).where(F.size("ws") > 0)
    e = e.withColumn("need", F.when(~F.col("concept") & (F.size("ws") <= FEW_WORDS), 1).otherwise(2))
    q = questions.select("question_id", words(F.col("question")).alias("qs"))
    common = e.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    rare = lambda df, key, ws: (
        df.select(key, F.explode(F.array_distinct(ws)).alias("w")).join(common, "w").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("by"))
    )
    words_of_e = e.join(rare(e, "example_id", "ws").withColumnRenamed("example_id", "_e"), F.col("example_id") == F.col("_e"))
    # A word that is there twice counts twice, so an example of one distinct word may still have two in common.
    cut = lambda by, keep: F.transform(F.slice(by, 1, F.greatest(F.lit(1), F.size(by) - keep)), lambda x: x["w"])
    left = words_of_e.select("example_id", "ws", "need", F.explode(cut(F.col("by"), F.when((F.col("need") == 2) & (F.size(F.array_distinct("ws")) == F.size("ws")), 1).otherwise(0))).alias("w"))
    asked = rare(q, "question_id", "qs")
    right = asked.select("question_id", F.explode(F.transform("by", lambda x: x["w"])).alias("w"))
    met = right.join(left.select("example_id", "w"), "w").select("question_id", "example_id").distinct()
    both = met.join(q, "question_id").join(e.select("example_id", "ws", "need"), "example_id")
    overlap = F.size(F.filter("ws", lambda w: F.array_contains("qs", w))).cast("long")
    return both.withColumn("overlap", overlap).where("overlap >= need").select("question_id", "example_id", "overlap", F.lit(0.5).alias("score"))


def normal(text: Column) -> Column:
    """Lower case, one space for any white space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def best_match(text: Column, candidate: Column, a: Column | str, b: Column | str) -> Column:
    """1 for equal normalised texts, else the cosine of their vectors."""
    return F.when(normal(text) == normal(candidate), F.lit(1.0)).otherwise(cosine(a, b))


def scope_match(hits: DataFrame, k: int, threshold: float = 0) -> DataFrame:
    """Per question the k best (entity, scope) of hits (question_id, entity, scope, score), each once at its best score."""
    once = hits.where(F.col("score") >= threshold).groupBy("question_id", "entity", "scope").agg(F.max("score").alias("score"))
    return top_per_group(once, k, "question_id", F.desc("score"), F.col("entity"), F.col("scope"))


def context_select(hits: DataFrame, edges: DataFrame, damping: float = 0.8) -> DataFrame:
    """entity, score: entity hits, and the ends of relationship hits at a lower score; the best of each.

    hits: kind (entity, relationship, scope), name, score; edges: name, source, target.
    """
    direct = hits.where("kind = 'entity'").select(F.col("name").alias("entity"), "score")
    ends = hits.where("kind = 'relationship'").join(edges, "name").select(F.explode(F.array("source", "target")).alias("entity"), (F.col("score") * damping).alias("score"))
    return direct.unionByName(ends).groupBy("entity").agg(F.max("score").alias("score"))


def semantic_index(texts: DataFrame) -> DataFrame:
    """A point for each (kind, entity, name, text), under an id that a repeated run gives again."""
    key = F.md5(F.concat_ws("|", "kind", "entity", "name", "text"))
    return texts.withColumn("id", key).dropDuplicates(["id"])
