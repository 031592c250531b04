"""Discovery from rows."""

import random

import pytest
from pyspark.sql.types import StringType, StructType

from graphquarry.operators import matching
from graphquarry.plans import discovery, profiling


def test_keys_from_rows(spark):
    rows = [(i, i // 3, i % 3, "x", None if i == 5 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a long, b long, c string, holes long")
    assert profiling.candidate_keys(df) == [("id",), ("a", "b")]
    assert profiling.candidate_keys(df.unionByName(df.limit(1))) == []
    assert profiling.candidate_keys(df.limit(0)) == []
    three = spark.createDataFrame([(i, j, k) for i in range(5) for j in range(5) for k in range(5)], "a int, b int, c int")
    assert profiling.candidate_keys(three) == [] and profiling.candidate_keys(three, 3) == [("a", "b", "c")]


def test_overlaps_and_foreign_keys(spark):
    rng = random.Random(2)
    customers = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id long, name string")
    orders = spark.createDataFrame([(i, rng.randrange(50), None if i % 7 == 0 else rng.randrange(40), f"n{rng.randrange(90)}") for i in range(400)], "id int, customer_id int, other_id long, label string")
    tables = {"customers": customers, "orders": orders}
    got = {(r.table_name, r.column_name, r.other_table, r.other_column): (r.n_values, r.n_common) for r in profiling.value_overlaps(tables).collect()}
    values = {(t, c): {str(r[0]) for r in df.select(c).collect() if r[0] is not None} for t, df in tables.items() for c in df.columns}
    kinds = {("customers", "name"): "s", ("orders", "label"): "s"}
    for a in values:
        for b in values:
            if a != b and kinds.get(a) == kinds.get(b) and values[a] & values[b]:
                assert got.pop((*a, *b)) == (len(values[a]), len(values[a] & values[b]))
    assert not got
    # other_id is included too, but no name says so; label isn't wholly included.
    assert profiling.foreign_keys(tables) == [("orders", "customer_id", "customers", "id")]
    assert profiling.foreign_keys({"customers": customers.unionByName(customers), "orders": orders}) == []


def test_statistics(spark):
    df = spark.createDataFrame([("a b c d e f " * 9, "u1", 1, [1]), (None, "u2", 2, None)], "text string, code string, n int, xs array<int>")
    got = {r.column_name: r for r in profiling.column_statistics(df).collect()}
    assert (got["text"].n_rows, got["text"].n_null, got["text"].avg_words) == (2, 1, 54.0) and got["xs"].n_distinct is None and got["n"].avg_chars is None
    text = profiling.column_statistics(df).where(profiling.is_text(profiling.F.col("avg_chars"), profiling.F.col("avg_words"))).collect()
    assert [r.column_name for r in text] == ["text"]


def test_rules_by_name():
    schema = StructType()
    for c in ("id", "details", "remarks", "api_token_text", "about", "first_name", "street", "key_summary"):
        schema = schema.add(c, StringType())
    assert discovery.text_columns(schema) == ["details", "remarks", "api_token_text", "key_summary"]
    # Excluded names come back in the second loop, as string columns with an embedded name.
    assert discovery.embed_fields(schema) == ["details", "remarks", "api_token_text", "about", "first_name", "key_summary"]
    assert [discovery.describe(c) for c in ("created_at", "team_member_id", "closed_on", "seen_at", "retry_count", "is_open", "has_parts", "net_price")] == [
        "Creation timestamp", "Foreign key to Team Member", "Closed date", "Seen timestamp", "Count of Retry", "Flag indicating if Open", "Flag indicating has Parts", "Net Price",
    ]


@pytest.mark.parametrize("seed", range(2))
def test_keyword_match_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["common", "the", "of", "it"] + [f"word{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(["common", *vocabulary]) for _ in range(n))
    questions, examples = [(i, text(rng.randrange(7))) for i in range(25)], [(i, text(rng.randrange(7)), rng.choice(["example", "concept"])) for i in range(40)]
    keep = lambda t: [w for w in t.lower().split() if len(w) > 2 and w not in matching.STOP_WORDS]
    want = set()
    for q, question in questions:
        for e, example, kind in examples:
            n = sum(w in keep(question) for w in keep(example))
            if n >= 2 or (kind == "example" and n == 1 and len(keep(example)) <= 3):
                want.add((q, e, n))
    got = matching.keyword_match(spark.createDataFrame(questions, "question_id long, question string"), spark.createDataFrame(examples, "example_id long, example string, kind string"))
    assert {(r.question_id, r.example_id, r.overlap) for r in got.collect()} == want
