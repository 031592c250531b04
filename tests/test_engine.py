"""Collections and the engine object."""

import pytest
from pyspark.sql import functions as F

from graphquarry.api import Engine
from graphquarry.operators import query
from graphquarry.plans import context, discovery
from graphquarry.plans.graph import PropertyGraph
from graphquarry.plans.model import EntityDef, RelDef, ScopeDef, VectorDef
from graphquarry.sources.collections import Collections


def test_collections(spark):
    c = Collections(spark, "t1_")
    assert c.create("notes", 3, payload="tag string") and not c.create("notes", 3)
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "b")], "vec_id long, embedding array<float>, tag string")
    c.upsert("notes", rows)
    c.upsert("notes", rows.where("vec_id = 2").withColumn("tag", F.lit("c")))
    assert {(r.vec_id, r.tag) for r in c.points("notes").collect()} == {(1, "a"), (2, "c")}
    assert c.search("notes", rows.where("vec_id = 2"), 1).first().vec_id == 2
    c.remove("notes", rows.where("vec_id = 1"))
    info = c.info("notes")
    assert (info.size, info.distance, info.points) == (3, "cosine", 1) and c.names() == ["notes"]
    c.clear("notes")
    assert c.info("notes").points == 0
    c.delete("notes")
    assert not c.exists("notes")
    c.upsert("auto", rows, "dot")
    assert (c.info("auto").size, c.info("auto").distance) == (3, "dot")
    for bad in (lambda: c.create("x; DROP TABLE y", 3), lambda: c.create("y", 3, "no_such")):
        with pytest.raises(ValueError):
            bad()


def test_readers_during_a_swap(spark, monkeypatch):
    """The name stands for a whole collection at every step of a write, also of one that dies; a reader goes on with its version."""
    c = Collections(spark, "t2_")
    rows = lambda *ids: spark.createDataFrame([(i, [1.0]) for i in ids], "vec_id long, embedding array<float>")
    seen = lambda: {r.vec_id for r in c.points("x").collect()}
    c.upsert("x", rows(1))
    steps, sql = [], spark.sql
    monkeypatch.setattr(c, "spark", type("Watched", (), {"__getattr__": lambda _, n: getattr(spark, n), "sql": lambda _, q, *a: (steps.append(seen()), sql(q, *a), steps.append(seen()))[1]})())
    reader = spark.read.table(c._table("x"))
    c.upsert("x", rows(2))
    assert reader.count() == 1 and all(s in ({1}, {1, 2}) for s in steps) and steps[-1] == {1, 2}
    with pytest.raises(Exception, match="broken"):
        c.upsert("x", rows(3).withColumn("vec_id", F.raise_error(F.lit("broken")).cast("long")))
    assert seen() == {1, 2} and c.exists("x")
    monkeypatch.undo()
    c.delete("x")
    assert not c.exists("x") and not c._versions("x")


@pytest.fixture
def engine(spark):
    people = spark.createDataFrame([(1, "Alice", "likes long walks", 10), (2, "Bob", "plays chess", None)], "id long, name string, bio string, team_id long")
    teams = spark.createDataFrame([(10, "Alpha Team")], "id long, name string")
    entities = [
        EntityDef("Person", "people", "id", relationships=(RelDef("MEMBER_OF", "Team", "team_id"),), vector=VectorDef("people", ("name", "bio"), ("name",)), aliases=("people",), scopes=(ScopeDef("teamed", F.col("team_id").isNotNull()),)),
        EntityDef("Team", "teams", "id"),
    ]
    return Engine(spark, PropertyGraph(spark, {"people": people, "teams": teams}.__getitem__, entities))


def test_engine(spark, engine):
    new = spark.createDataFrame([(2, "Bob", "plays chess and go", 10), (3, "Cleo", "bakes bread", None)], "id long, name string, bio string, team_id long")
    s = engine.ingest("Person", new).first()
    assert (s.total, s.succeeded, s.failed) == (2, 2, 0)
    assert engine.ingest("Person", new).first().succeeded == 2 and engine.graph.nodes("Person").count() == 3
    assert engine.search_similar("people", "who bakes bread", 1).first().vec_id == 3
    engine.remove("Person", spark.createDataFrame([(3,)], "id long"))
    assert engine.graph.nodes("Person").count() == 2 and engine.collections.points("people").count() == 1
    assert engine.ask("how many teamed people").first()[0] == 2
    out = engine.answer_question("list all people")
    assert out["rows"].count() == 2 and "table" in out["charts"]
    assert engine.retrieve_context("Which people are in a team?")["entities"] == {"Person": [], "Team": []}
    assert engine.get_example_entities("Person", 1).count() == 1
    assert engine.get_schema().where("kind = 'relationship'").first().name == "MEMBER_OF"


def test_context_and_names(engine):
    schema = context.relevant_schema(engine.graph, {"Team"})
    assert schema["labels"] == ["Person", "Team"] and schema["relationships"] == [("Person", "MEMBER_OF", "Team")]
    assert context.tokens("abcde") == 2 and context.compression(1, 4) == 0.75 and context.overall_score([]) == 0.0
    assert context.confidence(engine.graph, "person team", True) == 0.8
    assert discovery.inverse(engine.graph.entity("Person"), None) == "HAS_PEOPLE" and discovery.enabled(None, False) is False


def test_only_queries_pass(spark):
    query.check_read_only(spark, "SELECT created_at, offset FROM t WHERE drop_off = 1 UNION SELECT 1, 2")
    for sql in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a INT)", "SET a = b", "DELETE FROM t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(ValueError):
            query.check_read_only(spark, sql)
