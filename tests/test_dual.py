"""The dual store: what is committed, and what isn't when a view fails between the others."""

import pytest
from pyspark.sql import functions as F

from graphquarry.functions.embed import HashEmbedder, embed_distinct
from graphquarry.operators.dual import DualStore, InconsistentWrite, summary
from graphquarry.plans.graph import PropertyGraph
from graphquarry.plans.model import EntityDef, RelDef, VectorDef

PERSON = "id long, name string, bio string, team_id long"


@pytest.fixture
def store(spark, tmp_path):
    tables = {
        "people": spark.createDataFrame([(1, "Ann", "likes walks", 10), (2, "Bob", "plays chess", None)], PERSON),
        "teams": spark.createDataFrame([(10, "Alpha"), (20, "Beta")], "id long, name string"),
    }
    entities = [
        EntityDef("Person", "people", "id", relationships=(RelDef("MEMBER_OF", "Team", "team_id", {"since": "name"}),), vector=VectorDef("people", ("bio",), ("name",))),
        EntityDef("Team", "teams", "id"),
    ]
    return DualStore(spark, f"file://{tmp_path}/store", PropertyGraph(spark, tables.__getitem__, entities), lambda df, c: embed_distinct(df, c, HashEmbedder(8)), buckets=2)


def state(store):
    return (
        {tuple(r) for r in store.nodes("Person").collect()},
        {(r.src_id, r.dst_id) for r in store.edges("Person", "MEMBER_OF", "Team").collect()},
        {(r.vec_id, r.name) for r in store.points("Person").collect()},
    )


def people(store, *rows):
    return store.spark.createDataFrame(rows, PERSON)


def test_ingest_sync_and_remove(store):
    got = store.ingest("Person", people(store, (2, None, "plays go", 20), (3, "Cy", "bakes", 99)))
    assert {tuple(r) for r in got.collect()} == {(2, True, True, 1, None), (3, True, True, 0, None)}
    # Bob keeps the name that wasn't given; Cy's team doesn't exist.
    assert state(store) == ({(1, "Ann", "likes walks", 10), (2, "Bob", "plays go", 20), (3, "Cy", "bakes", 99)}, {(2, 20)}, {(2, None), (3, "Cy")})
    store.ingest("Person", people(store, (2, "Bob", "plays go", 10)))
    store.ingest("Person", people(store, (2, "Bob", "plays go", 10)))
    assert state(store)[1] == {(2, 10)} and len(state(store)[0]) == 3
    store.remove("Person", people(store, (3, None, None, None), (77, None, None, None)))
    assert state(store) == ({(1, "Ann", "likes walks", 10), (2, "Bob", "plays go", 10)}, {(2, 10)}, {(2, "Bob")})
    store.remove("Team", store.spark.createDataFrame([(10,)], "id long"))
    assert state(store)[1] == set() and {r.id for r in store.nodes("Team").collect()} == {20}
    before = state(store)
    store.sweep(1)
    assert state(store) == before


def test_batches_are_taken_apart(store):
    got = store.ingest_batch("Person", people(store, (3, "Cy", "bakes", 10), (4, "Di", None, 10), (None, "No", "id", None)))
    s = summary(got).first()
    assert (s.total, s.succeeded, s.partially_succeeded, s.failed) == (3, 1, 1, 1)
    assert {(r.id, r.error) for r in got.collect()} == {(3, None), (4, "no text to embed"), (None, "no id")}
    team = summary(store.ingest_batch("Team", store.spark.createDataFrame([(30, "Gamma")], "id long, name string"))).first()
    assert (team.succeeded, team.partially_succeeded) == (1, 0)


@pytest.mark.parametrize("operation", ["ingest", "remove"])
def test_a_failure_between_the_views(store, operation, monkeypatch):
    """Nodes and edges are staged, then the vectors fail: no view changes, no staged file stays."""
    store.ingest("Person", people(store, (3, "Cy", "bakes", 10)))
    before, version = state(store), store.manifest.version()
    files = lambda: {f: store.manifest.files.names(f) for f in store.manifest.files.names() if f != "manifest"}
    there = files()
    real = store._put

    def broken(states, table, *rest):
        if table.name.startswith("points"):
            raise OSError("disk")
        real(states, table, *rest)

    monkeypatch.setattr(store, "_put", broken)
    with pytest.raises(InconsistentWrite) as e:
        if operation == "ingest":
            store.ingest("Person", people(store, (3, "Changed", "bakes", 20)))
        else:
            store.remove("Person", people(store, (3, None, None, None)))
    assert (e.value.operation, e.value.view) == (operation, "vectors")
    monkeypatch.setattr(store, "_put", real)
    assert state(store) == before and store.manifest.version() == version and files() == there


def test_an_embedder_that_fails_in_a_task(store):
    before = state(store)
    store.embed = lambda df, c: df.withColumn("embedding", F.raise_error(F.lit("no model")).cast("array<float>"))
    with pytest.raises(InconsistentWrite, match="vectors"):
        store.ingest("Person", people(store, (5, "Ed", "sings", None)))
    assert state(store) == before


def test_strict_rows_and_readers(store):
    with pytest.raises(InconsistentWrite, match="without an id"):
        store.ingest("Person", people(store, (6, "Flo", "", None)))
    store.ingest("Person", people(store, (6, "Flo", "reads", None)))
    reader = store.nodes("Person")
    store.remove("Person", people(store, (6, None, None, None)))
    assert {r.id for r in reader.collect()} == {1, 2, 6} and {r.id for r in store.nodes("Person").collect()} == {1, 2}
