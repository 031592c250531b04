"""Graph, predicates, patterns, templates, discovery on small literals."""

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import ingest, insights, query
from graphquarry.plans import discovery, patterns, templates
from graphquarry.plans.graph import Hop, PropertyGraph
from graphquarry.plans.model import EntityDef, RelDef, ScopeDef, VectorDef, merge_config
from graphquarry.plans.predicates import Where, compare, temporal


@pytest.fixture(scope="module")
def shop(spark):
    """10 customers (5 active USA, 3 active Canada, 2 inactive) and 31 orders, 21 of them completed."""
    customers, orders = [], []
    for i in range(1, 11):
        customers.append((i, f"c{i}", "active" if i <= 8 else "inactive", "USA" if i <= 5 else "Canada" if i <= 8 else "France", 100.0 * i))
        for k in range(5 if i <= 5 else 2 if i <= 8 else 0):
            orders.append((len(orders) + 1, i, 50.0 * (k + 1), "completed" if k < (3 if i <= 5 else 2) else "pending"))
    data = {
        "customers": spark.createDataFrame(customers, "id long, name string, status string, country string, lifetime_value double"),
        "orders": spark.createDataFrame(orders, "id long, customer_id long, total double, status string"),
    }
    entities = [
        EntityDef("Customer", "customers", "id", scopes=(ScopeDef("active", F.col("status") == "active"),), aliases=("client",)),
        EntityDef("Order", "orders", "id", relationships=(RelDef("PLACED_BY", "Customer", "customer_id"),)),
    ]
    return PropertyGraph(spark, data.__getitem__, entities)


PLACED = Hop("PLACED_BY", "Order", "incoming")


def test_known_answers(shop):
    c, o = shop.nodes("Customer"), shop.nodes("Order")
    assert c.count() == 10 and Where().where("status", "active").apply(c).count() == 8
    assert Where().where("country", "USA").apply(c).count() == 5
    assert o.count() == 31 and o.where("status = 'completed'").count() == 21
    assert shop.related("Customer", [PLACED]).count() == 8 and shop.unrelated("Customer", [PLACED]).count() == 2
    pending = Hop("PLACED_BY", "Order", "incoming", F.col("status") == "pending")
    assert shop.related("Customer", [pending]).count() == 5


def test_semi_and_anti_joins_need_no_distinct(shop):
    plan = query.explain(shop.related("Customer", [PLACED]))
    assert "LeftSemi" in plan and "LeftAnti" in query.explain(shop.unrelated("Customer", [PLACED]))
    assert "TakeOrderedAndProject" in query.explain(shop.nodes("Order").orderBy(F.desc("total"), "id").limit(3))


def test_predicates(spark):
    df = spark.createDataFrame([(1, 2, "abc", "2024-01-02 10:00:00"), (2, 1, None, "2024-01-03 23:00:00"), (3, 3, "a_c", "2024-02-01 00:00:00")], "a int, b int, s string, t string").withColumn("t", F.to_timestamp("t"))
    ids = lambda w: sorted(r.a for r in w.apply(df).collect())
    assert ids(Where()) == [1, 2, 3] and ids(Where().where_in("a", [])) == [1, 2, 3] and ids(Where().where_not_in("a", [1])) == [2, 3]
    assert ids(Where().where("a", ">", 1).or_where("b", 2).where("s", "like", "%zz%")) == [2, 3]
    assert ids(Where().where(lambda w: w.where("a", 1).or_where("a", 3)).where("b", "<", 3)) == [1]
    assert ids(Where().where_null("s")) == [2] and ids(Where().where_not_null("s")) == [1, 3]
    assert ids(Where().where("s", "like", "%a_c%")) == [3] and ids(Where().where("s", "starts_with", "ab")) == [1] and ids(Where().where("s", "ends_with", "c")) == [1, 3]
    assert ids(Where().where_between("a", [2, 3])) == [2, 3] and ids(Where().where_not_between("a", [2, 3])) == [1] and ids(Where().where_between("a", [2])) == [1, 2, 3]
    assert ids(Where().where_column("a", ">", "b")) == [2] and ids(Where().where_date("t", ">", "2024-01-02")) == [2, 3] and ids(Where().where_time("t", ">=", "10:00:00")) == [1, 2]
    assert ids(Where().where(temporal("t", "within_last", anchor="2024-01-03 23:00:00", amount="2 days"))) == [1, 2]
    with pytest.raises(ValueError):
        compare("a", "~~", 1)


def test_patterns(shop):
    out = patterns.run("entity_with_aggregated_relationship", shop, base_entity="Customer", relationship="PLACED_BY", related_entity="Order", aggregate_property="total", aggregate_function="sum", operator=">", value=200)
    assert {r.id for r in out.collect()} == {1, 2, 3, 4, 5}
    with pytest.raises(ValueError, match="value"):
        patterns.run("property_filter", shop, entity="Customer", property="name", operator="equals")
    with pytest.raises(KeyError):
        patterns.run("no_such", shop)
    assert len(patterns.REGISTRY) == 11


def test_templates(shop):
    assert templates.answer(shop, "How many active customers?").first()[0] == 8
    assert templates.answer(shop, "show all clients").count() == 10
    assert templates.answer(shop, "list orders where total >= 250").count() == 5
    assert templates.answer(shop, "sum of total for orders").first()[0] > 0
    assert templates.answer(shop, "list customers and their orders").count() == 31
    with pytest.raises(ValueError):
        templates.answer(shop, "why?")
    with pytest.raises(KeyError):
        templates.answer(shop, "count dragons")


def test_paths(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 9), (9, 5)], "id long, parent long")
    g = PropertyGraph(spark, lambda _: tree, [EntityDef("Team", "t", "id", relationships=(RelDef("PARENT", "Team", "parent"),))])
    assert {(r.id, r.hops) for r in g.reach("Team", "parent", F.col("id") == 1).collect()} == {(1, 0), (2, 1), (3, 2), (4, 2)}
    assert {(r.id, r.hops) for r in g.reach("Team", "parent", F.col("id") == 5, 4).collect()} == {(5, 0), (9, 1)}
    assert g.any_direction("Team", "PARENT", "Team").count() == 8
    assert {(r.direction, r.other_id) for r in g.incident_edges("Team", 2).collect()} == {("outgoing", "1"), ("incoming", "3"), ("incoming", "4")}


def test_declarations():
    for bad in (lambda: EntityDef("", "t", "id"), lambda: RelDef("T", "", "k"), lambda: VectorDef("c", ())):
        with pytest.raises(ValueError):
            bad()
    e = EntityDef.from_config("A", {"table": "a", "graph": {"relationships": [{"type": "X", "target_label": "B", "foreign_key": "b_id"}, {"type": "Y", "target_label": "B"}]}})
    assert [r.type for r in e.relationships] == ["X"]
    assert merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_discovery(spark):
    schema = lambda ddl: spark.createDataFrame([], ddl).schema
    schemas = {"customers": schema("id long, name string, password string"), "orders": schema("id long, customer_id long, notes string, token_url string")}
    assert discovery.foreign_keys("orders", schemas) == [("customer_id", "customers", "id")]
    assert discovery.embed_fields(schemas["orders"]) == ["notes"] and "password" not in discovery.properties(schemas["customers"])
    e = discovery.discover("orders", schemas)
    assert e.label == "Order" and e.relationships[0] == RelDef("BELONGS_TO_CUSTOMER", "Customer", "customer_id")
    assert "purchases" in e.aliases and discovery.plural("category") == "categories" and discovery.singular("boxes") == "box"
    assert discovery.is_identifier("a_1") and not discovery.is_identifier("a-b") and not discovery.is_identifier("x; DROP")


def test_ingestion(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, note string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, name string")
    up = {tuple(r) for r in ingest.upsert_nodes(old, new, "id").collect()}
    assert up == {(1, "a", "x"), (2, "B", "y"), (3, "c", None)}
    edges = spark.createDataFrame([(10, 1), (11, 2)], "src_id long, dst_id long")
    left, (kept,) = ingest.delete_nodes(old, [(edges, ("dst_id",))], old.where("id = 2"), "id")
    assert left.count() == 1 and {tuple(r) for r in kept.collect()} == {(10, 1)}
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 5)], "id long, fk long")
    status = ingest.edge_status(rows, "id", "fk", spark.createDataFrame([(5,)], "id long"), spark.createDataFrame([(4, 5)], "src_id long, dst_id long"))
    assert tuple(ingest.sync_summary(status).first()) == (3, 1, 1, 1)
    versions = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k long, v long, x string")
    assert {r.x for r in ingest.latest(versions, "k", "v").collect()} == {"new", "only"}


def test_pages_and_insights(spark):
    df = spark.range(45)
    p = query.paginate(df, 3, 20, "id")
    assert (p.last_page, p.from_row, p.to_row, p.total) == (3, 41, 45, 45) and p.rows.count() == 5
    assert query.paginate(df.where("id < 0"), 0, 0, "id").from_row == 1
    assert query.execute(df.union(df).union(df)).count() == 100 and query.execute(df, None).count() == 45
    out = insights.insights(spark.createDataFrame([(1, 10.0, "x"), (1, 100.0, "y")], "a int, b double, s string")).first()
    assert out["count"] == 4 and out.high_outlier and out.low_outlier
    assert insights.insights(spark.createDataFrame([("x",)], "s string")).first()["count"] == 0
    assert insights.suggest_charts(["count"], 1) == ["number"] and insights.suggest_charts(["a"], 1) == ["table"]


def test_reach_ends_at_cycles_and_takes_the_shortest_way(spark):
    rows = spark.createDataFrame([(1, 4), (2, 1), (3, 1), (4, 3), (5, 2), (5, 3), (6, None)], "id long, up long")
    view = PropertyGraph(spark, {"parts": rows}.__getitem__, [EntityDef("Part", "parts", "id")])
    got = {r.id: r.hops for r in view.reach("Part", "up", F.col("id") == 1).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
    assert {r.id for r in view.reach("Part", "up", F.col("id") == 1, max_hops=1).collect()} == {1, 2, 3}
    assert view.reach("Part", "up", F.col("id") == 9).count() == 0


def test_metadata_criteria(spark):
    rows = spark.createDataFrame([(1, "pdf", 10, "2024-01-01"), (2, "pdf", 20, "2024-02-01"), (3, "txt", 30, "2024-03-01"), (4, None, 5, None)], "id long, kind string, size long, uploaded_at string")
    ids = lambda *a, **k: [r.id for r in query.search_metadata(rows, *a, **k).collect()]
    assert ids({}) == [3, 2, 1, 4] and ids({}, limit=1) == [3]
    assert ids({"kind": "pdf", "size": (15, None)}) == [2] and ids({"kind": ["pdf", "txt"], "size": (None, 20)}) == [2, 1]
    assert ids({}, after="2024-02-01") == [3, 2] and ids({}, before="2024-02-01") == [2, 1]


def test_answers_are_whole(spark):
    """More rows than the hundred that once was the most."""
    many = spark.range(250).selectExpr("id", "id AS total", "id % 120 AS owner_id")
    owners = spark.range(120).selectExpr("id")
    entities = [EntityDef("Bill", "bills", "id", relationships=(RelDef("OWED_BY", "Owner", "owner_id"),)), EntityDef("Owner", "owners", "id")]
    g = PropertyGraph(spark, {"bills": many, "owners": owners}.__getitem__, entities)
    assert templates.answer(g, "list bills where total >= 10").count() == 240
    assert templates.answer(g, "show all bills").count() == 250
    assert templates.answer(g, "show all bills", limit=7).count() == 7
    assert templates.answer(g, "list owners and their bills").count() == 250
