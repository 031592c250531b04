"""Matching questions with large dictionaries: by names that stand in them, and by candidates in the order of priority.

Dictionaries are tables, not parts of a plan. A block of names is held by every task as an
Aho-Corasick automaton, which reads a question once however many names there are. Candidates meet questions in groups of a
shuffle, a piece of the ones with a piece of the others, as products of matrices; nothing of either goes through the driver.
What a block or piece finds for a question is merged by an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.operators.matching import normal
from graphquarry.operators.vectors import block_scores, matrix

#: Names in an automaton (some 100 bytes each), candidates in a matrix, questions that meet it at once.
NAME_BLOCK = 200_000
CANDIDATE_BLOCK = 4096
QUESTIONS_AT_ONCE = 256
#: Questions and candidates of a group. Every question is sent once for each piece of candidates, and the other way round.
QUESTION_PIECE = 20_000
CANDIDATE_PIECE = 20_000


def blocks(df: DataFrame, key: Column, size: int) -> Iterator[pa.Table]:
    """df in parts of about `size` rows, by a hash of key: what the driver holds at once."""
    n = max(1, -(-df.count() // size))
    for b in range(n):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(n)) == b).toArrow()
        if part.num_rows:
            yield part


def dictionary_match(texts: DataFrame, names: DataFrame, key: str = "question_id", text: str = "question", block: int = NAME_BLOCK) -> DataFrame:
    """key, entity: the entities with a name (column name) that stands in the text, whatever the case. Empty and null names stand in none."""
    import ahocorasick

    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    lowered = texts.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("_low"))
    known = names.select(F.lower("name").alias("name"), "entity").where("name <> ''").distinct()
    found = []
    for part in blocks(known, F.col("name"), block):
        # The words go to the tasks, which build the automaton: it has no portable form.
        held = spark.sparkContext.broadcast((part.column("name").to_pylist(), part.column("entity").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            entities: dict[str, list[str]] = {}
            for name, entity in zip(*held.value):
                entities.setdefault(name, []).append(entity)
            automaton = ahocorasick.Automaton()
            for name, own in entities.items():
                automaton.add_word(name, own)
            automaton.make_automaton()
            for b in batches:
                rows, hits = [], []
                for i, low in enumerate(b.column(1).to_pylist()):
                    own = {e for _, es in automaton.iter(low) for e in es}
                    rows += [i] * len(own)
                    hits += sorted(own)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=[key, "entity"])

        found.append(lowered.mapInArrow(run, f"`{key}` {kind}, entity string"))
    if not found:
        return texts.select(key, F.lit("").alias("entity")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def _near(questions: DataFrame, candidates: DataFrame, threshold: float, best: bool, block: int) -> DataFrame:
    """question_id, entity, priority, text, score: per question and entity the first candidate by priority that passes; or (best) the closest one."""
    asked = questions.where(F.col("embedding").isNotNull()).select("question_id", F.col("embedding").cast("array<float>" if _floats(questions, candidates) else "array<double>").alias("v"))
    named = candidates.where(F.col("embedding").isNotNull()).select("entity", "priority", "text", F.col("embedding").cast("array<float>" if _floats(questions, candidates) else "array<double>").alias("v"))
    kind = questions.schema["question_id"].dataType.simpleString()
    n_asked, n_named = (max(1, -(-df.count() // size)) for df, size in ((asked, QUESTION_PIECE), (named, CANDIDATE_PIECE)))
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Rows that are alike in all of these differ in their place in a task, so a piece isn't filled by copies.
    spread = F.concat_ws("|", "entity", "text", F.col("priority").cast("string"))
    left = asked.select("question_id", "v", own(n_asked, "question_id").alias("_q"), every(n_named).alias("_c"))
    right = named.withColumn("_c", own(n_named, spread, F.monotonically_increasing_id())).select("entity", "priority", "text", "v", "_c", every(n_asked).alias("_q"))

    def run(asked: pa.Table, named: pa.Table) -> pa.Table:
        found = [[], [], []]
        if asked.num_rows and named.num_rows:
            named = named.sort_by([("entity", "ascending"), ("priority", "ascending"), ("text", "ascending")])
            codes = named.column("entity").combine_chunks().dictionary_encode()
            codes = np.nan_to_num(np.asarray(codes.indices.to_numpy(zero_copy_only=False), float), nan=-1).astype(np.int64)
            for at in range(0, asked.num_rows, QUESTIONS_AT_ONCE):
                q = matrix(asked.column("v").slice(at, QUESTIONS_AT_ONCE))
                # Of each question: the best candidate so far, or the first of each entity; a block more at a time.
                for start in range(0, named.num_rows, block):
                    c = matrix(named.column("v").slice(start, block), q.shape[1])
                    scores, own = block_scores("cosine", c, q).T, codes[start : start + block]
                    if best:
                        top = scores.argmax(1)
                        rows = np.flatnonzero(scores[np.arange(len(top)), top] >= threshold)
                        cols = top[rows]
                    else:
                        # Candidates stand by entity and priority: the first that passes among those of an entity counts.
                        edges = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
                        places = np.where(scores >= threshold, np.arange(len(own)), len(own))
                        first = np.minimum.reduceat(places, edges, axis=1)
                        rows, _ = np.nonzero(first < len(own))
                        cols = first[first < len(own)]
                    for column, values in zip(found, (rows + at, cols + start, scores[rows, cols])):
                        column.append(values)
        rows, cols, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        if len(rows):
            # One row a question (and entity) leaves the task.
            group = rows if best else rows * (codes.max() + 2) + codes[cols] + 1
            order = np.lexsort((cols, -values, group) if best else (cols, group))
            kept = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
            rows, cols, values = rows[kept], cols[kept], values[kept]
        asked, named = asked.select(["question_id"]).take(pa.array(rows, pa.int64())), named.select(["entity", "priority", "text"]).take(pa.array(cols, pa.int64()))
        return pa.table([asked.column(0), *named.columns, pa.array(values, pa.float64())], names=["question_id", "entity", "priority", "matched_text", "score"])

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(run, f"question_id {kind}, entity string, priority long, matched_text string, score double")


def _floats(*sides: DataFrame) -> bool:
    """Whether vectors are stored as floats on both sides: then they are sent as such, and scored as doubles."""
    return all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in sides)


def _all_hits(questions: DataFrame, candidates: DataFrame, threshold: float, best: bool, block: int) -> DataFrame:
    """Exact hits (equal but for case and white space, score 1) and near ones."""
    q = questions.where(F.col("question") != "")
    c = candidates.select(F.col("entity").cast("string").alias("entity"), F.col("priority").cast("long").alias("priority"), "text", "embedding").where("text <> ''")
    on = normal(F.col("question")) == normal(F.col("text"))
    exact = q.select("question_id", "question").join(c.drop("embedding"), on).select("question_id", "entity", "priority", F.col("text").alias("matched_text"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    return exact.unionByName(_near(q, c, threshold, best, block).withColumn("exact", F.lit(False)))


def priority_match(questions: DataFrame, candidates: DataFrame, threshold: float = 0.75, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """question_id, entity, score, exact, matched_text: for each entity the first of its candidates, by priority, that passes.

    questions: question_id, question, embedding. candidates: entity, priority (name, then aliases, then description), text, embedding.
    A text that equals the question but for case and white space passes with score 1, another one if its cosine reaches the threshold.
    """
    hits = _all_hits(questions, candidates, threshold, False, block)
    order = F.struct("priority", ~F.col("exact"), -F.col("score"), "matched_text")
    first = hits.groupBy("question_id", "entity").agg(F.min_by(F.struct("score", "exact", "matched_text"), order).alias("m"))
    return first.select("question_id", "entity", "m.*")


def label_match(questions: DataFrame, candidates: DataFrame, threshold: float = 0.70, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """question_id, entity, score, exact, matched_text: the one best candidate of each question; an exact one before any other."""
    hits = _all_hits(questions, candidates, threshold, True, block)
    # min_by over what is better when smaller; equal ones go by priority, then name.
    order = F.struct(~F.col("exact"), F.when(F.col("exact"), 0.0).otherwise(-F.col("score")), "priority", "entity", "matched_text")
    return hits.groupBy("question_id").agg(F.min_by(F.struct("entity", "score", "exact", "matched_text"), order).alias("m")).select("question_id", "m.*")
