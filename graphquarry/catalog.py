"""The registered queries of the engine's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.functions import text as X
from graphquarry.functions.embed import HashEmbedder, embed_distinct
from graphquarry.functions.redaction import redact_json
from graphquarry.operators import dual
from graphquarry.operators import ingest as I
from graphquarry.operators import insights as N
from graphquarry.operators import matching as M
from graphquarry.operators import query as Q
from graphquarry.operators import vector_index as vector_lists
from graphquarry.operators import vectors as V
from graphquarry.operators import semantic
from graphquarry.operators.dual import DualStore
from graphquarry.plans import discovery, profiling, templates
from graphquarry.plans import patterns as P
from graphquarry.plans.graph import Hop, PropertyGraph
from graphquarry.plans.model import EntityDef
from graphquarry.plans.predicates import Where, temporal
from graphquarry.plans.steps import Steps
from graphquarry.sources import files, processing, scratch, tables
from graphquarry.sources.collections import Collections
from graphquarry.streaming import changes
from graphquarry.streaming.changelog import ChangeFeed, ChangeTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(graph, read) under its name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables.graph(spark, sf_dir), tables.reader(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '', '', 'g'), ' ')"
CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
PLACED = Hop("PLACED_BY", "Order", "incoming")


# Scans, projections and limits
@query(f"SELECT {CUSTOMER} FROM customer ORDER BY c_custkey LIMIT 100")
def list_all(g, t):
    return Q.execute(g.nodes("Customer").orderBy("c_custkey"))


@query("SELECT count(*) AS n FROM orders")
def count_label(g, t):
    return g.nodes("Order").agg(F.count("*").alias("n"))


@query(f"SELECT {ORDER} FROM orders WHERE o_orderkey = 7")
def get_node(g, t):
    return g.node("Order", 7)


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def execute_count(g, t):
    return Q.execute_count(g.nodes("Order").where("o_orderstatus = 'F'"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def project_properties(g, t):
    return I.project_properties(t("supplier").withColumn("s_password", F.lit("x")))


LABELS = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "LineItem": "lineitem", "Event": "events", "Document": "documents"}
LINKS = {"IN_REGION": ("nation n_regionkey",), "IN_NATION": ("customer c_nationkey", "supplier s_nationkey"), "PLACED_BY": ("orders o_custkey",), "OF_ORDER": ("lineitem l_orderkey",), "OF_PART": ("lineitem l_partkey",), "FROM_SUPPLIER": ("lineitem l_suppkey",)}


@query(
    " UNION ALL ".join(f"SELECT 'label' AS kind, '{x}' AS name, count(*) AS n FROM {table}" for x, table in LABELS.items())
    + "".join(f" UNION ALL SELECT 'relationship', '{x}', " + " + ".join("(SELECT count({1}) FROM {0})".format(*own.split()) for own in ends) for x, ends in LINKS.items())
    + " UNION ALL SELECT 'property', column_name, count(*) FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{x}'" for x in LABELS.values()) + ") GROUP BY column_name"
)
def graph_schema(g, t):
    """Labels with their nodes, relationship types with their edges, properties with the labels that have them."""
    return g.statistics()


@query("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS json FROM nation")
def format_json(g, t):
    return Q.as_json(g.nodes("Nation"))


@query("""SELECT n_nationkey::VARCHAR AS id, 'Nation' AS label, n_name AS name FROM nation UNION ALL SELECT r_regionkey::VARCHAR, 'Region', r_name FROM region
UNION ALL SELECT user_id::VARCHAR, 'User', arg_max(event_type, event_id) FROM events GROUP BY user_id""")
def format_graph(g, t):
    """Nodes once each: users by their events, of which the last one counts."""
    n = Q.graph_nodes(g.nodes("Nation"), "Nation", "n_nationkey").select("id", "label", F.col("properties")["n_name"].alias("name"))
    r = Q.graph_nodes(g.nodes("Region"), "Region", "r_regionkey").select("id", "label", F.col("properties")["r_name"].alias("name"))
    u = Q.graph_nodes(g.nodes("Event"), "User", "user_id", "event_id").select("id", "label", F.col("properties")["event_type"].alias("name"))
    return n.unionByName(r).unionByName(u)


@query("SELECT 'IN_REGION' AS type, n_nationkey::VARCHAR AS start, n_regionkey::VARCHAR AS \"end\" FROM nation")
def format_relationships(g, t):
    return Q.graph_relationships(g.edges("Nation", "IN_REGION", "Region"), "IN_REGION")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 100.5")
def sql_params(g, t):
    return Q.run_sql(t, ["customer"], g.spark, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :nation AND c_acctbal > :bar", nation=3, bar=100.5)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def flatten_nodes(g, t):
    return Q.flatten(g.nodes("Nation").select(F.struct("*").alias("n")), "n")


@query("SELECT p_partkey FROM part WHERE (suffix(lower(p_type), 'ard') OR suffix(lower(p_type), 'omo')) AND NOT p_size = 1")
def file_type_filter(g, t):
    """Types joined by OR inside an AND, and a negated condition."""
    kinds = lambda w: w.where(F.lower("p_type").endswith("ard")).or_where(F.lower("p_type").endswith("omo"))
    return Where().where(kinds).where(~(F.col("p_size") == 1)).apply(g.nodes("Part")).select("p_partkey")


# Predicates
@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100")
def find_by_property(g, t):
    rows = P.run("property_filter", g, entity="Customer", property="c_mktsegment", operator="equals", value="BUILDING")
    return Q.execute(rows.select("c_custkey").orderBy("c_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 490000")
def filter_condition(g, t):
    return Where().where("o_totalprice", ">", 490000).apply(g.nodes("Order")).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'")
def op_not_equals(g, t):
    return Where().where("c_mktsegment", "!=", "BUILDING").apply(g.nodes("Customer")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '0001')")
def op_contains(g, t):
    return Where().where("c_name", "like", "%0001%").apply(g.nodes("Customer")).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'PRO')")
def op_starts_with(g, t):
    return Where().where("p_type", "starts_with", "PRO").apply(g.nodes("Part")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE suffix(p_type, 'ARD')")
def op_ends_with(g, t):
    return Where().where("p_type", "ends_with", "ARD").apply(g.nodes("Part")).select("p_partkey", "p_type")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def op_greater_than(g, t):
    return P.run("property_filter", g, entity="Customer", property="c_acctbal", operator="greater_than", value=9000).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < -500")
def op_less_than(g, t):
    return P.run("property_filter", g, entity="Customer", property="c_acctbal", operator="less_than", value=-500).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 480000")
def where_in(g, t):
    return Where().where_in("o_orderpriority", ["1-URGENT", "2-HIGH"]).where("o_totalprice", ">", 480000).apply(g.nodes("Order")).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def where_not_in(g, t):
    return Where().where_not_in("o_orderstatus", ["F", "O"]).where_in("o_orderkey", []).apply(g.nodes("Order")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def where_null(g, t):
    return Where().where_null("quality").apply(t("documents").join(t("labels"), "doc_id", "left")).select("doc_id")


@query("SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def where_not_null(g, t):
    return Where().where_not_null("quality").apply(t("documents").join(t("labels"), "doc_id", "left")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000")
def where_between(g, t):
    return P.run("property_range", g, entity="Order", property="o_totalprice", min_value=100000, max_value=101000).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n FROM orders WHERE NOT (o_totalprice BETWEEN 100000 AND 101000)")
def where_not_between(g, t):
    return Where().where_not_between("o_totalprice", [100000, 101000]).apply(g.nodes("Order")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'")
def where_date(g, t):
    return Where().where_date("ts", "=", "2024-01-02").apply(g.nodes("Event")).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(ts AS TIME) >= TIME '23:50:00'")
def where_time(g, t):
    return Where().where_time("ts", ">=", "23:50:00").apply(g.nodes("Event")).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount AND l_quantity >= 49")
def where_column(g, t):
    return Where().where_column("l_tax", ">", "l_discount").where("l_quantity", ">=", 49).apply(g.nodes("LineItem")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND (o_totalprice > 495000 OR (o_orderpriority = '1-URGENT' AND o_totalprice < 10000))")
def nested_where(g, t):
    inner = lambda w: w.where("o_totalprice", ">", 495000).or_where(lambda v: v.where("o_orderpriority", "1-URGENT").where("o_totalprice", "<", 10000))
    return Where().where("o_orderstatus", "P").where(inner).apply(g.nodes("Order")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_acctbal < 0")
def multiple_filters_or(g, t):
    filters = [("c_mktsegment", "equals", "MACHINERY"), ("c_acctbal", "<", 0)]
    return P.run("multiple_property_filter", g, entity="Customer", filters=filters, combine="OR").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
def or_where(g, t):
    return Where().where("c_acctbal", "<", 0).or_where("c_mktsegment", "BUILDING").where("c_acctbal", ">", 9000).apply(g.nodes("Customer")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AND TIMESTAMP '2001-08-01'")
def temporal_within_last(g, t):
    return P.run("temporal_filter", g, entity="Order", property="o_orderdate", operator="within_last", anchor="2001-08-01", amount="30 days").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-08'")
def temporal_within_next(g, t):
    return g.nodes("Order").where(temporal("o_orderdate", "within_next", anchor="1998-01-01", amount="7 days")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31'")
def temporal_between(g, t):
    return P.run("temporal_filter", g, entity="Order", property="o_orderdate", operator="between", value="1998-01-01", until="1998-01-31").select("o_orderkey")


@query("SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS before, count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') AS after FROM orders")
def temporal_before_after(g, t):
    count = lambda c: F.count(F.when(c, 1))
    return g.nodes("Order").agg(count(temporal("o_orderdate", "before", value="1996-01-01")).alias("before"), count(temporal("o_orderdate", "after", value="2001-01-01")).alias("after"))


# Relationships
@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def relationship_query(g, t):
    return g.traverse("Nation", [Hop("IN_REGION", "Region")]).select("n_name", "r_name")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND o_orderstatus = 'F'")
def traversal_filtered(g, t):
    path = [Hop("PLACED_BY", "Order", "incoming", F.col("o_orderstatus") == "F"), Hop("OF_ORDER", "LineItem", "incoming", F.col("l_quantity") >= 50)]
    return P.run("relationship_traversal", g, start_entity="Customer", path=path).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def with_relationship(g, t):
    return P.run("entity_with_relationship", g, entity="Customer", relationship="PLACED_BY", target_entity="Order", where=F.col("o_orderstatus") == "P").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def without_relationship(g, t):
    return P.run("entity_without_relationship", g, entity="Customer", relationship="PLACED_BY", target_entity="Order", where=F.col("o_orderstatus") == "P").select("c_custkey")


@query("SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def rel_count_at_least(g, t):
    return g.aggregate_related("Customer", PLACED, n_orders=F.count("*")).where("n_orders >= 15").select("c_custkey", "n_orders")


@query("SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 4000000")
def aggregated_relationship(g, t):
    rows = P.run(
        "entity_with_aggregated_relationship", g, base_entity="Customer", relationship="PLACED_BY", related_entity="Order",
        aggregate_property="o_totalprice", aggregate_function="sum", operator="greater_than", value=4000000, alias="total",
    )
    return rows.select("c_custkey", F.round("total", 2).alias("total"))


@query("SELECT o_custkey AS c_custkey, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) BETWEEN 250000 AND 260000")
def aggregated_between(g, t):
    rows = P.run(
        "entity_with_aggregated_relationship", g, base_entity="Customer", relationship="PLACED_BY", related_entity="Order",
        aggregate_property="o_totalprice", aggregate_function="avg", operator="between", value=(250000, 260000), alias="mean",
    )
    return rows.select("c_custkey", F.round("mean", 2).alias("mean"))


@query("""SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND o_totalprice > 490000""")
def multi_hop(g, t):
    hops = [Hop("IN_REGION", "Nation", "incoming"), Hop("IN_NATION", "Customer", "incoming"), Hop("PLACED_BY", "Order", "incoming", F.col("o_totalprice") > 490000)]
    return P.run("multi_hop_traversal", g, start_entity="Region", hops=hops, where=F.col("r_name") == "ASIA").select("r_name", "n_name", "c_custkey", "o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""")
def relationship_with_filters(g, t):
    filters = [("c_mktsegment", "=", "BUILDING"), ("c_acctbal", ">", 5000)]
    return P.run("relationship_with_property_filter", g, entity="Customer", filters=filters, relationship="PLACED_BY", target_entity="Order", where=F.col("o_totalprice") > 480000).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def composed_and(g, t):
    c = g.nodes("Customer")
    return P.run("compose", g, parts=[c.where("c_acctbal > 9000"), c.where("c_mktsegment = 'BUILDING'")], combine="AND", key="c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def composed_union(g, t):
    c = g.nodes("Customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return P.run("compose", g, parts=[c.where("c_acctbal > 9000"), c.where("c_mktsegment = 'BUILDING'")], combine="UNION", key="c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'AUTOMOBILE'")
def scoped(g, t):
    return P.apply_scopes(g.nodes("Customer"), [g.entity("Customer").scopes[0], F.col("c_mktsegment") == "AUTOMOBILE"]).select("c_custkey")


@query("""SELECT 'Nation' AS src_label, n_nationkey AS src_id, 'Region' AS dst_label, n_regionkey AS dst_id FROM nation
UNION SELECT 'Region', n_regionkey, 'Nation', n_nationkey FROM nation""")
def relationship_any(g, t):
    return g.any_direction("Nation", "IN_REGION", "Region")


@query("""SELECT 'IN_REGION' AS type, 'outgoing' AS direction, 'Region' AS other_label, n_regionkey::VARCHAR AS other_id FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'IN_NATION', 'incoming', 'Customer', c_custkey::VARCHAR FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'IN_NATION', 'incoming', 'Supplier', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey = 3""")
def incident_edges(g, t):
    return g.incident_edges("Nation", 3)


@query("SELECT DISTINCT b.l_orderkey AS related FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_orderkey = 1 AND b.l_orderkey <> 1")
def related_nodes(g, t):
    return g.sharing("LineItem", "l_partkey", F.col("l_orderkey") == 1)


@query("""SELECT DISTINCT 'IN_NATION' AS type, 'Customer' AS other_label, c_custkey::VARCHAR AS other_id FROM customer WHERE c_nationkey = 3
UNION SELECT 'IN_NATION', 'Supplier', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey = 3""")
def neighbours(g, t):
    return g.neighbours("Nation", 3, "IN_NATION")


@query("SELECT r_name, n_name, s_suppkey, 2 AS hops FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'EUROPE'")
def path_hops(g, t):
    rows = g.traverse("Region", [Hop("IN_REGION", "Nation", "incoming"), Hop("IN_NATION", "Supplier", "incoming")], F.col("r_name") == "EUROPE")
    return rows.select("r_name", "n_name", "s_suppkey", F.lit(2).alias("hops"))


@query("""WITH RECURSIVE p AS (SELECT n_nationkey AS id, 0 AS hops FROM nation WHERE n_nationkey = 1
UNION ALL SELECT n_nationkey, hops + 1 FROM nation JOIN p ON n_nationkey // 2 = p.id AND n_nationkey > 1 WHERE hops < 10) SELECT id, hops FROM p""")
def var_length_path(g, t):
    """A binary tree over nation keys."""
    tree = g.nodes("Nation").withColumn("parent", F.when(F.col("n_nationkey") > 1, F.floor(F.col("n_nationkey") / 2).cast("int")))
    return PropertyGraph(g.spark, lambda _: tree, [EntityDef("N", "n", "n_nationkey")]).reach("N", "parent", F.col("n_nationkey") == 1)


@query("SELECT count(*) > 0 AS allowed FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 1 AND o_orderstatus = 'F'")
def auth_bool(g, t):
    return g.related("Customer", [Hop("PLACED_BY", "Order", "incoming", F.col("o_orderstatus") == "F")], g.node("Customer", 1)).agg((F.count("*") > 0).alias("allowed"))


# Aggregates
@query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS sum_price, round(avg(o_totalprice), 2) AS avg_price, min(o_totalprice) AS min_price,
max(o_totalprice) AS max_price FROM orders""")
def aggregate_property(g, t):
    p = "o_totalprice"
    return g.nodes("Order").agg(F.count("*").alias("n"), F.round(F.sum(p), 2).alias("sum_price"), F.round(F.avg(p), 2).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_count(g, t):
    return g.nodes("Order").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def group_rel_count(g, t):
    return g.aggregate_related("Nation", Hop("IN_NATION", "Customer", "incoming"), n=F.count("*")).select("n_name", "n")


@query("""SELECT l_partkey AS dst_id, round(sum(l_quantity), 2) AS quantity, round(max(l_discount), 4) AS discount FROM lineitem
GROUP BY l_partkey ORDER BY quantity DESC, dst_id LIMIT 10""")
def relprop_agg(g, t):
    e = g.edges("LineItem", "OF_PART", "Part").groupBy("dst_id").agg(F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.max("discount"), 4).alias("discount"))
    return e.orderBy(F.desc("quantity"), "dst_id").limit(10)


@query("""WITH x AS (SELECT unnest([p_partkey::DOUBLE, p_size::DOUBLE, p_retailprice]) AS x FROM part)
SELECT count(x) AS "count", round(sum(x), 2) AS "sum", round(avg(x), 4) AS "avg", min(x) AS "min", max(x) AS "max",
max(x) > 2 * avg(x) AS high_outlier, min(x) > 0 AND min(x) < 0.5 * avg(x) AS low_outlier FROM x""")
def insights(g, t):
    out = N.insights(g.nodes("Part"))
    return out.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round("avg", 4))


@query("""SELECT doc_id || ' (integer)' AS doc_id, coalesce('''' || CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END || ''' (string)', 'null') AS text,
coalesce('''' || lang || ''' (string)', 'null') AS lang, '''2024-01-0' || doc_id % 7 || ''' (string date - compare as: property < ''2024-01-0' || doc_id % 7 || ''')' AS day, '[' || doc_id || ',1] (array)' AS pair FROM documents""")
def labelled_values(g, t):
    """Documents as examples show them: each value with its type."""
    day = F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 7).cast("string"))
    d = t("documents").select("doc_id", F.regexp_replace("text", "^[0-9]{4}-[0-9]{2}-", "").alias("text"), "lang", day.alias("day"), F.array(F.col("doc_id"), F.lit(1).cast("long")).alias("pair"))
    return N.labelled(d)


@query("""WITH r AS (SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50)
SELECT 'c_custkey,c_name' AS headers, string_agg(c_custkey || ',' || c_name, ';' ORDER BY c_acctbal DESC, c_custkey) AS rows FROM r""")
def chat_table(g, t):
    """The fifty richest customers as the one row that a chat shows."""
    top = t("customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name")
    one = N.as_table(top, 50)
    return one.select(F.array_join("headers", ",").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


@query(f"""WITH c AS (SELECT doc_id, lang, {CLEAN_SQL} AS text FROM documents WHERE lang <> 'de')
SELECT doc_id, md5(lower(text)) AS cleaned, length(text) AS n_chars FROM c WHERE length(text) > 100""")
def steps(g, t):
    """A chain of named steps, changed after it was made: one removed, one replaced, one put before another."""
    chain = Steps().add("measure", lambda d: d.withColumn("n_chars", F.char_length("text")), 90).add("clean", lambda d: d.withColumn("text", X.clean_text(F.col("text"))), 10)
    chain.add("none", lambda d: d.limit(0), 20).add("upper", lambda d: d.withColumn("text", F.upper("text")), 95)
    chain.before("clean", lambda d: d.where("lang <> 'de'")).remove("none").after("measure", lambda d: d.where("n_chars > 100")).replace("upper", lambda d: d.withColumn("cleaned", F.md5(F.lower("text"))))
    return chain.run(t("documents").select("doc_id", "lang", "text")).select("doc_id", "cleaned", F.col("n_chars").cast("long").alias("n_chars"))


@query("SELECT c_mktsegment, round(100.0::DOUBLE * count(*) FILTER (c_acctbal > 0) / count(*), 4) AS share FROM customer GROUP BY c_mktsegment")
def ratio(g, t):
    share = F.try_divide(F.lit(100.0) * F.count(F.when(F.col("c_acctbal") > 0, 1)), F.count("*"))
    return g.nodes("Customer").groupBy("c_mktsegment").agg(F.round(share, 4).alias("share"))


@query("SELECT count(*) AS n_files, sum(n_chars)::BIGINT AS total_size, round(avg(n_chars), 4) AS avg_size FROM documents")
def file_stats(g, t):
    return files.file_statistics(t("documents").withColumnRenamed("n_chars", "size")).withColumn("avg_size", F.round("avg_size", 4))


@query("SELECT lower(string_split(o_orderpriority, '-')[-1]) AS extension, count(*) AS n FROM orders GROUP BY 1")
def file_type_hist(g, t):
    return files.type_histogram(g.nodes("Order"), "o_orderpriority", "-")


# Order, pages, windows
@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_n(g, t):
    return g.nodes("Customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent(g, t):
    return g.nodes("Order").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def paginate(g, t):
    return Q.page_rows(g.nodes("Customer").select("c_custkey"), 3, 20, "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k, count(*) OVER () AS n FROM lineitem)
WHERE (k - 1) // 100 = n // 200""")
def deep_page(g, t):
    """The page in the middle of all line items, by price: read from the ranges that hold its rows."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    ranges = Q.Ranges(rows, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))
    return ranges.slice(ranges.total // 200 * 100, 100)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def global_ranks(g, t):
    """The place of each order among all, without a sort in one task."""
    return Q.Ranges(t("orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey")).ranked().select("o_orderkey", "rank")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def history_last_n(g, t):
    return Q.history_last(t("conversations"), 3).select("conv_id", "turn", "role")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' AND length(text) > 200 THEN left(text, 200) || '...' ELSE text END, chr(10) ORDER BY turn) AS context
FROM k WHERE k BETWEEN 2 AND 11 GROUP BY conv_id""")
def history_context(g, t):
    return Q.history_context(t("conversations"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def best_per_group(g, t):
    return Q.best_per_group(t("documents").select("source", "doc_id", "n_chars"), "source", F.desc("n_chars"), F.col("doc_id"))


@query("""WITH d AS (SELECT d.doc_id, d.lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT *, 2 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS n_known FROM d)
SELECT lang, doc_id, n_known FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_known DESC, doc_id) AS r FROM k) WHERE r <= 2""")
def example_entities(g, t):
    d = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")
    return Q.example_entities(d, 2, "lang", "doc_id").select("lang", "doc_id", "n_known")


# Vectors
VECTOR_SQL = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, {f}(embedding::DOUBLE[], q) AS score FROM embeddings, q {where})
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score {order}, vec_id LIMIT 5"""


def _knn(t, metric, **how):
    e = t("embeddings")
    return V.knn(e, e.where("vec_id = 0"), 5, metric, **how).select("vec_id", F.round("score", 6).alias("score"))


@query(VECTOR_SQL.format(f="list_cosine_similarity", where="", order="DESC"))
def vec_cosine(g, t):
    return _knn(t, "cosine")


@query(VECTOR_SQL.format(f="list_inner_product", where="", order="DESC"))
def vec_dot(g, t):
    return _knn(t, "dot")


@query(VECTOR_SQL.format(f="list_distance", where="", order="ASC"))
def vec_euclid(g, t):
    return _knn(t, "euclid")


@query(VECTOR_SQL.format(f="list_cosine_similarity", where="WHERE label = 3", order="DESC"))
def vec_filtered(g, t):
    return _knn(t, "cosine", where=F.col("label") == 3)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 1000""")
def vec_threshold(g, t):
    e = t("embeddings")
    return V.knn(e, e.where("vec_id = 0"), 1000, threshold=0.2).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS n FROM embeddings WHERE label = 3")
def vec_count(g, t):
    return V.count_points(t("embeddings"), F.col("label") == 3)


@query("SELECT vec_id, CASE WHEN label = 3 THEN -1 ELSE label END AS label FROM embeddings")
def vec_upsert(g, t):
    e = t("embeddings")
    return V.upsert_points(e, e.where("label = 3").withColumn("label", F.lit(-1))).select("vec_id", "label")


@query("SELECT vec_id, CASE WHEN label = 5 THEN -5 ELSE label END AS label, len(embedding)::INT AS size, (count(*) OVER ())::BIGINT AS points FROM embeddings WHERE label <> 3")
def collection_points(g, t):
    """A collection from its first upsert to its deletion: points are inserted, replaced and removed in between."""
    store, e = Collections(g.spark, f"vec_{uuid.uuid4().hex[:8]}_"), t("embeddings")
    store.upsert("docs", e)
    store.upsert("docs", e.where("label = 5").withColumn("label", F.lit(-5).cast(e.schema["label"].dataType)))
    store.remove("docs", e.where("label = 3"))
    info = store.info("docs")
    left = scratch.materialise(store.points("docs").select("vec_id", "label", F.lit(info.size).alias("size"), F.lit(info.points).cast("long").alias("points")), "points")
    store.delete("docs")
    return left


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(s, 6) AS score FROM r WHERE rank <= 3""")
def knn_join(g, t):
    e = t("embeddings")
    return V.knn_join(e.where("vec_id % 100 = 0"), e, 3).withColumn("score", F.round("score", 6))


@query()
def vector_index(g, t):
    """Inverted lists over all vectors, tuned for ten neighbours; tests hold its recall against the exact join."""
    e = t("embeddings")
    q = e.where("vec_id % 100 = 0")
    index = vector_lists.build(e, scratch.folder(g.spark, "vector-index")).tune(q)
    return index.search(q, 10).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_distance(embedding::DOUBLE[], q) AS s FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(s, 6) AS score FROM r WHERE rank <= 5""")
def vector_index_exact(g, t):
    """The same lists by distance, all of them probed and re-ranked as a whole: the index loses no row."""
    e = t("embeddings")
    index = vector_lists.build(e, scratch.folder(g.spark, "vector-index"), "euclid")
    found = index.search(e.where("vec_id % 100 = 0"), 5, probes=len(index.model.centres), depth=0)
    return found.withColumn("score", F.round("score", 6))


GROUPED_SQL = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
h AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY 3 DESC, 1 LIMIT 30)
SELECT label, round(avg(s), 6) AS avg_score, count(*) AS n_chunks, arg_max(vec_id, (s, -vec_id)) AS best_chunk FROM h GROUP BY label"""


@query(GROUPED_SQL)
def chunk_group_score(g, t):
    e = t("embeddings")
    return V.search_content(e, e.where("vec_id = 0"), 10, "label").withColumn("avg_score", F.round("avg_score", 6))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
h AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 60)
SELECT vec_id, lang, round(s, 6) AS score FROM h JOIN documents ON doc_id = vec_id WHERE lang = 'en' ORDER BY s DESC, vec_id LIMIT 10""")
def hybrid_search(g, t):
    e = t("embeddings")
    out = V.search_hybrid(e, e.where("vec_id = 0"), t("documents").select("doc_id", "lang"), ("vec_id", "doc_id"), F.col("lang") == "en", 10)
    return out.select("vec_id", "lang", F.round("score", 6).alias("score"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src2') AND n_chars BETWEEN 2000 AND 20000 AND doc_id IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 10")
def metadata_search(g, t):
    d = t("documents").join(t("labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")
    return Q.search_metadata(d, {"source": ["src1", "src2"], "n_chars": (2000, 20000)}, "n_chars", key="doc_id")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 100000 AND o_orderdate BETWEEN '1995-01-01' AND '1997-06-30'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def metadata_dates(g, t):
    """Orders as uploads: criteria and bounds of dates."""
    criteria = {"o_orderstatus": ["O", "P"], "o_totalprice": (100000, None)}
    found = Q.search_metadata(g.nodes("Order"), criteria, "o_orderdate", datetime(1995, 1, 1), datetime(1997, 6, 30), "o_orderkey", 50)
    return found.select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 5 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def files_by_owner(g, t):
    owner = g.node("Customer", 5)
    rows = g.related("Order", [Hop("PLACED_BY", "Customer")], g.nodes("Order").where("o_custkey = 5"))
    return rows.join(owner, rows.o_custkey == owner.c_custkey, "left_semi").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)


@query("""WITH p AS (SELECT embedding::DOUBLE[] AS v, vec_id FROM embeddings), u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p),
m AS (SELECT i, sum(CASE WHEN vec_id IN (1, 2) THEN x / 2 WHEN vec_id = 3 THEN -x END) AS x FROM u WHERE vec_id IN (1, 2, 3) GROUP BY i),
q AS (SELECT list(x ORDER BY i) AS q FROM m)
SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM p, q WHERE vec_id NOT IN (1, 2, 3) ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 5""")
def recommend(g, t):
    return V.recommend(t("embeddings"), [1, 2], [3], 5).select("vec_id", F.round("score", 6).alias("score"))


# Matching
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in M.STOP_WORDS) + "]"
WORDS_SQL = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + STOP_SQL + ", w))"


@query(f"""WITH q AS (SELECT conv_id * 1000 + turn AS question_id, {WORDS_SQL.format('text')} AS qs FROM conversations WHERE role = 'user'),
e AS (SELECT item_id AS example_id, {WORDS_SQL.format('text')} AS ws, item_id % 4 = 0 AS concept FROM benchmark),
b AS (SELECT question_id, example_id, concept, len(ws) AS n, len(list_filter(ws, lambda w: list_contains(qs, w))) AS overlap FROM q, e)
SELECT question_id, example_id, overlap, 0.5::DOUBLE AS score FROM b WHERE overlap >= 2 OR (overlap = 1 AND n <= 3 AND NOT concept)""")
def keyword_match(g, t):
    """Every fourth benchmark item stands for a concept."""
    q = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    kind = F.when(F.col("item_id") % 4 == 0, "concept").otherwise("example")
    return M.keyword_match(q, t("benchmark").select(F.col("item_id").alias("example_id"), F.col("text").alias("example"), kind.alias("kind")))


@query("SELECT n_nationkey, CASE WHEN lower(n_name) = 'nation_3' THEN 1.0::DOUBLE ELSE round((3 * n_nationkey + 2) / (sqrt(n_nationkey * n_nationkey + 1) * sqrt(13.0::DOUBLE)), 6) END AS score FROM nation")
def best_match(g, t):
    a, b = F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)), F.array(F.lit(3.0), F.lit(2.0))
    return g.nodes("Nation").select("n_nationkey", F.round(M.best_match(F.col("n_name"), F.lit(" Nation_3 "), a, b), 6).alias("score"))


@query("SELECT DISTINCT c.conv_id AS question_id, n.entity FROM conversations c, (VALUES ('Greeting', 'the'), ('Hedge', 'thing'), ('Never', '§§')) n(entity, name) WHERE contains(lower(c.text), n.name)")
def entity_match(g, t):
    names = g.spark.createDataFrame([("Greeting", "the"), ("Hedge", "Thing"), ("Never", "§§")], "entity string, name string")
    return semantic.dictionary_match(t("conversations").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question")), names)


@query("""WITH n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[0-9A-Za-z_]{6,}'))) AS name FROM benchmark)
SELECT DISTINCT conv_id AS question_id, left(name, 2) AS entity FROM conversations JOIN n ON contains(lower(text), name) WHERE name <> ''""")
def dictionary_match(g, t):
    """All longer words of the benchmark as names of entities, the latter called by two letters."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[0-9A-Za-z_]{6,}"), F.lit(0)))
    names = t("benchmark").select(word.alias("name")).distinct().select("name", F.lower(F.substring("name", 1, 2)).alias("entity"))
    return semantic.dictionary_match(t("conversations").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question")), names)


#: Every hundredth vector asks; all are candidates of their label's entity, by their number. Some say what a question says, but for case and spaces.
MATCH_SQL = """WITH q AS (SELECT vec_id AS question_id, 'Vector ' || vec_id AS question, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT label::VARCHAR AS entity, vec_id AS priority, ' vector  ' || (vec_id // 50 * 50) AS text, embedding::DOUBLE[] AS e FROM embeddings),
h AS (SELECT question_id, entity, priority, text, trim(replace(text, '  ', ' ')) = lower(question) AS exact, list_cosine_similarity(q, e) AS s FROM q, c),
m AS (SELECT *, CASE WHEN exact THEN 1.0::DOUBLE ELSE round(s, 6) END AS score FROM h WHERE exact OR s >= 0.25)"""


def _candidates(t):
    e = t("embeddings")
    number = F.col("vec_id").cast("string")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.concat(F.lit("Vector "), number).alias("question"), "embedding")
    text = F.concat(F.lit(" vector  "), (F.floor(F.col("vec_id") / 50) * 50).cast("string"))
    return asked, e.select(F.col("label").cast("string").alias("entity"), F.col("vec_id").alias("priority"), text.alias("text"), "embedding")


@query(MATCH_SQL + " SELECT question_id, entity, arg_min(score, priority) AS score, arg_min(exact, priority) AS exact FROM m GROUP BY 1, 2")
def priority_match(g, t):
    found = semantic.priority_match(*_candidates(t), 0.25, block=200)
    return found.select("question_id", "entity", F.round("score", 6).alias("score"), "exact")


@query(MATCH_SQL + " SELECT question_id, arg_min(entity, (NOT exact, CASE WHEN exact THEN 0 ELSE -s END, priority)) AS entity, max(score) AS score FROM m GROUP BY 1")
def label_match(g, t):
    found = semantic.label_match(*_candidates(t), 0.25, block=200)
    return found.select("question_id", "entity", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT vec_id % 7 AS question_id, 'e' || (label % 3)::VARCHAR AS entity, 's' || label::VARCHAR AS scope, embedding[1]::DOUBLE AS score FROM embeddings),
o AS (SELECT question_id, entity, scope, max(score) AS score FROM h WHERE score >= 0.05 GROUP BY ALL)
SELECT question_id, entity, scope, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entity, scope) AS k FROM o) WHERE k <= 3""")
def scope_match(g, t):
    label = F.col("label")
    hits = t("embeddings").select(
        (F.col("vec_id") % 7).alias("question_id"), F.concat(F.lit("e"), (label % 3).cast("string")).alias("entity"), F.concat(F.lit("s"), label.cast("string")).alias("scope"), F.col("embedding")[0].cast("double").alias("score")
    )
    return M.scope_match(hits, 3, 0.05).withColumn("score", F.round("score", 6))


@query("""SELECT entity, round(max(score), 6) AS score FROM (SELECT n_name AS entity, n_nationkey / 30.0::DOUBLE AS score FROM nation WHERE n_nationkey < 20
UNION ALL SELECT unnest([n_name, 'R' || n_regionkey::VARCHAR]), 0.8::DOUBLE * (n_nationkey / 30.0::DOUBLE) FROM nation WHERE n_nationkey >= 20) GROUP BY entity""")
def context_select(g, t):
    n = g.nodes("Nation")
    kind = F.when(F.col("n_nationkey") < 20, "entity").otherwise("relationship")
    hits = n.select(kind.alias("kind"), F.col("n_name").alias("name"), (F.col("n_nationkey") / 30.0).alias("score"))
    edges = n.select(F.col("n_name").alias("name"), F.col("n_name").alias("source"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("target"))
    return M.context_select(hits, edges).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT md5('entity|Part|' || p_type || '|' || p_type) AS id, p_type AS name FROM part")
def semantic_index(g, t):
    p = g.nodes("Part").select(F.lit("entity").alias("kind"), F.lit("Part").alias("entity"), F.col("p_type").alias("name"), F.col("p_type").alias("text"))
    return M.semantic_index(p).select("id", "name")


@query("SELECT count(*) AS count FROM customer WHERE c_acctbal > 5000")
def question_count(g, t):
    return templates.answer(g, "How many rich customers?")


@query("SELECT round(avg(o_totalprice), 4) AS result FROM orders")
def question_aggregation(g, t):
    return templates.answer(g, "average o_totalprice of orders").select(F.round("result", 4).alias("result"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000")
def question_filtering(g, t):
    return templates.answer(g, "show suppliers where s_acctbal > 9000").select("s_suppkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def question_relationship(g, t):
    return templates.answer(g, "list nations and their region").select("n_name", "r_name")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def traversal_scope(g, t):
    view = PropertyGraph(g.spark, lambda n: g.read(n).withColumn("status", F.col("o_orderstatus")) if n == "orders" else g.read(n), [*g.entities.values()])
    (scope,) = discovery.traversal_scopes(view, "Customer", PLACED, {"P": "with_pending"})
    return scope.apply(view.nodes("Customer")).select("c_custkey")


#: Tables of the star schema, with their whole-number and string columns.
STAR = {
    "region": (("r_regionkey",), ("r_name",)),
    "nation": (("n_nationkey", "n_regionkey"), ("n_name",)),
    "customer": (("c_custkey", "c_nationkey"), ("c_name", "c_mktsegment")),
    "supplier": (("s_suppkey", "s_nationkey"), ("s_name",)),
    "part": (("p_partkey", "p_size"), ("p_name", "p_brand", "p_type")),
    "orders": (("o_orderkey", "o_custkey"), ("o_orderstatus", "o_orderpriority")),
    "lineitem": (("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ("l_returnflag", "l_linestatus")),
}
VALUES_SQL = "v AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' || {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, kinds in STAR.items() for k, cs in zip("ns", kinds) for c in cs) + ")"
OVERLAP_SQL = f"""WITH {VALUES_SQL}, n AS (SELECT t, c, count(*) AS n FROM v GROUP BY t, c),
o AS (SELECT a.t AS table_name, a.c AS column_name, b.t AS other_table, b.c AS other_column, count(*) AS n_common FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL),
i AS (SELECT o.*, n.n AS n_values FROM o JOIN n ON n.t = table_name AND n.c = column_name)"""


@query(f"{OVERLAP_SQL} SELECT table_name, column_name, other_table, other_column, n_values, n_common FROM i")
def inclusions(g, t):
    """How far the values of each column are those of another one's, over all rows of all tables."""
    return profiling.value_overlaps({n: t(n) for n in STAR})


KEYS_SQL = "k AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(*) = count(DISTINCT {c}) AS is_key FROM {t}" for t, kinds in STAR.items() for c in kinds[0]) + ")"


@query(f"""{OVERLAP_SQL}, {KEYS_SQL} SELECT table_name, column_name, other_table AS target, other_column AS target_column FROM i JOIN k ON k.t = other_table AND k.c = other_column
WHERE n_common = n_values AND is_key AND table_name <> other_table AND split_part(column_name, '_', 2) = split_part(other_column, '_', 2)""")
def infer_fks(g, t):
    """From the rows: whole inclusion in another table's key, and names that agree."""
    found = profiling.foreign_keys({n: t(n) for n in STAR})
    return g.spark.createDataFrame(found, "table_name string, column_name string, target string, target_column string")


@query("""SELECT 'orders' AS table_name, 'o_orderkey' AS key FROM orders HAVING count(*) = count(DISTINCT o_orderkey)
UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber' FROM lineitem HAVING count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AND count(*) > count(DISTINCT l_orderkey)
UNION ALL SELECT 'conversations', 'conv_id,turn' FROM conversations HAVING count(*) = count(DISTINCT (conv_id, turn))""")
def candidate_keys(g, t):
    """Keys of one and two columns, told from the rows; of columns that may hold ids (no prices, dates or texts)."""
    wanted = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "lineitem": ["l_orderkey", "l_linenumber", "l_returnflag"], "conversations": ["conv_id", "turn", "role"]}
    rows = [(n, ",".join(k)) for n, cs in wanted.items() for k in profiling.candidate_keys(t(n).select(*cs))]
    return g.spark.createDataFrame(rows, "table_name string, key string")


FOUND_SQL = " UNION ALL ".join(
    f"SELECT '{source}' AS source, 'BELONGS_TO_{column.upper()}' AS type, '{target}' AS target, count({column}) AS n_edges FROM {table}"
    for source, table, column, target in (
        ("Nation", "nation", "n_regionkey", "Region"), ("Customer", "customer", "c_nationkey", "Nation"), ("Supplier", "supplier", "s_nationkey", "Nation"), ("Order", "orders", "o_custkey", "Customer"),
        ("Lineitem", "lineitem", "l_orderkey", "Order"), ("Lineitem", "lineitem", "l_partkey", "Part"), ("Lineitem", "lineitem", "l_suppkey", "Supplier"),
    )
)


@query(FOUND_SQL)
def discovered_graph(g, t):
    """A graph whose entities and relationships were told from rows, and its edges."""
    found = PropertyGraph(g.spark, t, profiling.discover_entities({n: t(n).select(*[c for kinds in cs for c in kinds]) for n, cs in STAR.items()}))
    edges = [found.edges(e.label, r.type, r.target).select(F.lit(e.label).alias("source"), F.lit(r.type).alias("type"), F.lit(r.target).alias("target")) for e in found.entities.values() for r in e.relationships]
    return reduce(DataFrame.unionByName, edges).groupBy("source", "type", "target").agg(F.count("*").alias("n_edges"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def inverse_relationship(g, t):
    """Customers and their orders, along the relationship's inverse name."""
    hop = discovery.inverse_hops([*g.entities.values()])["Customer"]["HAS_ORDERS"]
    return g.traverse("Customer", [hop], F.col("c_acctbal") > 9000).select("c_custkey", "o_orderkey")


TEXTS = {"documents": ("text", "lang", "source"), "conversations": ("role", "text"), "benchmark": ("item_id", "text"), "events": ("event_type", "props"), "part": ("p_name", "p_brand", "p_type")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(avg(length({c}::VARCHAR)), 3) AS avg_chars FROM {t} HAVING avg(length({c}::VARCHAR)) >= 40 AND avg(len(regexp_extract_all({c}::VARCHAR, '\\S+'))) >= 5" for t, cs in TEXTS.items() for c in cs))
def text_columns(g, t):
    """String columns that hold texts, by what their rows are like."""
    parts = [profiling.column_statistics(t(n)).where(profiling.is_text(F.col("avg_chars"), F.col("avg_words"))).select(F.lit(n).alias("table_name"), "column_name", F.round("avg_chars", 3).alias("avg_chars")) for n in TEXTS]
    return reduce(DataFrame.unionByName, parts)


# Text
@query("SELECT doc_id, length(text)::BIGINT AS n_chars, len(string_split(text, chr(10)))::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::BIGINT AS n_words FROM documents")
def text_stats(g, t):
    return t("documents").select("doc_id", *X.text_statistics(F.col("text")))




@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace({CLEAN_SQL}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS cleaned FROM documents")
def clean_text(g, t):
    return t("documents").select("doc_id", F.md5(X.clean_document(F.col("text"))).alias("cleaned"))


# The same patterns without references to earlier groups, which DuckDB's expressions lack.
UNREFERENCED = {r"(\*\*|__)(.*?)\1": r"\*\*(.*?)\*\*|__(.*?)__", r"(\*|_)(.*?)\1": r"\*(.*?)\*|_(.*?)_"}


def chain_sql(text: str, steps) -> str:
    for find, put in steps:
        put = r"\1\2" if find in UNREFERENCED else put.replace("$", "\\")
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, UNREFERENCED.get(find, find).replace("'", "''"), put)
    return text


@query(f"""WITH m AS (SELECT doc_id, '# Title' || chr(10) || '- **' || lang || '** [link](http://x)' || chr(10) || '> ' || text AS md FROM documents)
SELECT doc_id, {chain_sql("md", X.MARKDOWN)} AS text, (len(regexp_extract_all(md, '\\[[^\\]]+\\]\\([^\\)]+\\)')) - len(regexp_extract_all(md, '!\\[[^\\]]+\\]\\([^\\)]+\\)')))::INT AS n_links FROM m""")
def strip_markdown(g, t):
    d = t("documents").select("doc_id", F.concat(F.lit("# Title\n- **"), F.col("lang"), F.lit("** [link](http://x)\n> "), F.col("text")).alias("md"))
    return d.select("doc_id", X.strip_markdown(F.col("md")).alias("text"), X.markdown_metadata(F.col("md"))["n_links"].alias("n_links"))


@query(r"""WITH m AS (SELECT doc_id, lang, '---' || chr(10) || 'title: ' || lang || chr(10) || '---' || chr(10) || '# H' || chr(10) || '[l](u) ![i](v)' || chr(10) || text AS md FROM documents)
SELECT doc_id, len(regexp_extract_all(md, '(?m)^#{1,6}\s+\S'))::INT AS n_headers, (len(regexp_extract_all(md, '\[[^\]]+\]\([^\)]+\)')) - 1)::INT AS n_links,
len(regexp_extract_all(md, '!\[[^\]]*\]\([^\)]+\)'))::INT AS n_images, lang AS title FROM m""")
def md_metadata(g, t):
    head = F.concat(F.lit("---\ntitle: "), F.col("lang"), F.lit("\n---\n# H\n[l](u) ![i](v)\n"), F.col("text"))
    m = t("documents").select("doc_id", X.markdown_metadata(head).alias("m"))
    return m.select("doc_id", "m.n_headers", "m.n_links", "m.n_images", F.col("m.front_matter")["title"].alias("title"))


TYPED = {"orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}, "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"}}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS type, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null FROM {t}" for t, cs in TYPED.items() for c, k in cs.items()))
def column_types(g, t):
    """Types, with the rows and nulls of each column."""
    parts = [profiling.column_statistics(t(n)).select(F.lit(n).alias("table_name"), "column_name", "type", "n_rows", "n_null") for n in TYPED]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT doc_id, md5({chain_sql('text', X.SECRETS)}) AS redacted FROM documents")
def redact(g, t):
    return t("documents").select("doc_id", F.md5(X.redact(F.col("text"))).alias("redacted"))


@query(f"""SELECT conv_id, turn, md5(to_json({{'conv_id': conv_id, 'dbPassword': '***REDACTED***', 'message': {{'parts': [{chain_sql("coalesce(text, '')", X.SECRETS)}, {chain_sql("'password=' || role", X.SECRETS)}], 'role': role}},
'trace': {{'a': {{'b': {{'c': {{'d': ['***MAX_DEPTH_REACHED***']}}}}}}}}, 'turn': turn}})::VARCHAR) AS redacted FROM conversations""")
def redact_nested(g, t):
    """Conversations as JSON trees: secrets by key and in strings, at any depth, and a branch that is too deep."""
    message = F.struct(F.array(F.coalesce("text", F.lit("")), F.concat(F.lit("password="), F.col("role"))).alias("parts"), "role")
    deep = F.lit(1)
    for name in "fedcba":
        deep = F.struct(deep.alias(name))
    tree = F.to_json(F.struct("conv_id", F.struct(F.col("text")).alias("dbPassword"), message.alias("message"), deep.alias("trace"), "turn"))
    return t("conversations").select("conv_id", "turn", F.md5(redact_json(tree)).alias("redacted"))


@query("""SELECT event_id, CASE WHEN (props->>'k')::INT % 2 = 0 THEN '{"props":' || replace(props, ' ', '') || ',"session":{"accessToken":"***REDACTED***","user":' || user_id || '}}' ELSE replace(props, ' ', '') END AS redacted FROM events""")
def redact_events(g, t):
    """The properties of events as they are logged, half of them with a session around."""
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    logged = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "session": {"user": '), F.col("user_id").cast("string"), F.lit(', "accessToken": ["'), F.col("event_type"), F.lit('"]}}'))
    return g.nodes("Event").select("event_id", redact_json(F.when(even, logged).otherwise(F.col("props"))).alias("redacted"))


@query("SELECT doc_id, CASE WHEN text[1] IN ('{', '[') THEN ceil(ceil(length(text) / 4.0) * 1.2::DOUBLE) ELSE ceil(length(text) / 4.0) END::BIGINT AS tokens FROM documents")
def token_estimate(g, t):
    return t("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT event_id, concat_ws(' ', nullif(event_type, ''), nullif(props, '')) AS embed_text FROM events")
def embed_text(g, t):
    return g.nodes("Event").select("event_id", I.embed_text("event_type", "props").alias("embed_text"))


@query("""SELECT doc_id, (i // 800)::INT AS chunk_index, md5(substr(text, i + 1, 1000)) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents) WHERE trim(substr(text, i + 1, 1000)) <> ''""")
def char_chunks(g, t):
    return X.char_chunks(t("documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index", F.md5("content").alias("chunk"))


def chunks_sql(text: str, size: int, overlap: int) -> str:
    """c: doc_id, n, content. Paragraphs (p) or sentences (q) are packed by their cumulative lengths (a), a chunk a step; else windows."""
    longest = "list_max(list_transform({}, lambda x: length(x)))".format
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace({text}, '\r\n?', chr(10), 'g') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda x: x <> '') AS p,
list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS q FROM d WHERE regexp_matches(t, '\S')),
h AS (SELECT *, CASE WHEN length(t) <= {size} THEN 'whole' WHEN {longest("p")} <= {size} THEN 'p' WHEN {longest("q")} <= {size} THEN 'q' ELSE 'windows' END AS how FROM s),
u AS (SELECT doc_id, CASE how WHEN 'p' THEN p ELSE q END AS us, CASE how WHEN 'p' THEN chr(10) || chr(10) ELSE ' ' END AS glue FROM h WHERE how IN ('p', 'q')),
l AS (SELECT *, length(glue) AS g, list_transform(us, lambda x: length(x) + length(glue)) AS ls FROM u),
k AS (SELECT *, list_transform(range(0, len(ls) + 1), lambda i: coalesce(list_sum(ls[1:i]), 0)::BIGINT) AS a FROM l),
r AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS f, greatest(1, len(list_filter(a, lambda x: x <= {size})) - 1)::BIGINT AS e FROM k
UNION ALL SELECT doc_id, n + 1, nf, greatest(e + 1, len(list_filter(a, lambda x: x <= a[nf + 1] + {size} + CASE WHEN nf < e THEN g ELSE 0 END)) - 1)::BIGINT
FROM (SELECT r.*, k.a, k.g, greatest(r.f, len(list_filter(k.a, lambda x: x < k.a[r.e + 1] - k.g - {overlap})))::BIGINT AS nf FROM r JOIN k USING (doc_id) WHERE r.e < len(k.us))),
c AS (SELECT * FROM (SELECT doc_id, n, CASE g WHEN 2 THEN array_to_string(us[f + 1:e], chr(10) || chr(10)) ELSE array_to_string(us[f + 1:e], ' ') END AS content FROM r JOIN k USING (doc_id) UNION ALL SELECT doc_id, 0, t FROM h WHERE how = 'whole'
UNION ALL SELECT doc_id, i, substr(t, i + 1, {size}) FROM (SELECT doc_id, t, unnest(range(0, length(t), {size - overlap})) AS i FROM h WHERE how = 'windows')) WHERE regexp_matches(content, '\S'))
"""


@query(chunks_sql("text", 1000, 200) + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks, content FROM c")
def chunk_semantic(g, t):
    return X.chunk_table(t("documents"), "doc_id", "text")


@query("""WITH c AS (SELECT doc_id AS file_id, (i // 800)::INT AS chunk_index, length(substr(text, i + 1, 1000)) AS n
FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents) WHERE trim(substr(text, i + 1, 1000)) <> '')
SELECT file_id, chunk_index, coalesce(sum(n) OVER w, 0)::BIGINT AS start_position, (coalesce(sum(n) OVER w, 0) + n)::BIGINT AS end_position FROM c
WINDOW w AS (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chunk_positions(g, t):
    c = X.char_chunks(t("documents").select(F.col("doc_id").alias("file_id"), "text"), "text").drop("text")
    return I.chunk_positions(c).drop("content")


@query("""SELECT (i // 800)::INT AS chunk_index, md5(substr(text, i + 1, 1000)) AS chunk FROM (SELECT text, unnest(range(0, length(text), 800)) AS i FROM documents WHERE doc_id = 9)
WHERE trim(substr(text, i + 1, 1000)) <> ''""")
def file_chunks(g, t):
    c = X.char_chunks(t("documents").where("doc_id = 9").select("text"), "text")
    return c.orderBy("chunk_index").select("chunk_index", F.md5("content").alias("chunk"))


@query("""SELECT doc_id AS file_id, count(*) AS n_chunks FROM (SELECT doc_id, lang, text, unnest(range(0, length(text), 800)) AS i FROM documents)
WHERE trim(substr(text, i + 1, 1000)) <> '' AND lang IS DISTINCT FROM 'de' GROUP BY doc_id""")
def chunk_store(g, t):
    """Chunks are written by file, those of German files are deleted, and the rest is counted."""
    d, path = t("documents").withColumnRenamed("doc_id", "file_id"), scratch.folder(g.spark, "chunks")
    files.write_chunks(X.char_chunks(d.select("file_id", "text"), "text").drop("text"), path)
    return files.count_chunks(files.without_file(g.spark.read.parquet(path), d.where("lang = 'de'")))


@query(chunks_sql(CLEAN_SQL, *X.CHUNK_SIZES["txt"]) + "SELECT doc_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars FROM c GROUP BY doc_id")
def file_pipeline(g, t):
    """Clean, chunk, count: a file's way from text to chunk rows."""
    cleaned = t("documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))
    return X.chunk_table(cleaned, "doc_id", "text", *X.CHUNK_SIZES["txt"]).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("content")).alias("n_chars"))


def _bundles(t):
    """Files of some documents each, by source and number, a row a document: k, name, part, content, before. Some are broken or of no known type.

    Documents of one doc_id stand by a digest: rows that are sorted hold their text once.
    """
    k = F.col("doc_id") % 20
    d = t("documents").select("doc_id", F.concat_ws("-", F.coalesce("source", F.lit("none")), k.cast("string")).alias("bundle"), F.coalesce("text", F.lit("")).alias("text"), k.alias("k"))
    kind = F.when(F.col("k") == 17, ".exe").when(F.col("k") == 18, ".docx").when(F.col("k") == 19, ".md").otherwise(".TXT")
    blank = F.col("k") == 16
    content, before = F.when(blank, " \n\t ").otherwise(F.col("text")), F.when(blank, "").otherwise("\n\n")
    return d.select("k", F.concat("bundle", kind).alias("name"), F.struct(F.lit(0).alias("at"), "doc_id", F.md5("text").alias("text")).alias("part"), F.encode(content, "UTF-8").alias("content"), F.encode(before, "UTF-8").alias("before"))


@query(f"""WITH d AS (SELECT coalesce(source, 'none') || '-' || doc_id % 20 AS bundle, doc_id % 20 AS k, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL),
e AS (SELECT bundle, k, CASE WHEN k = 16 THEN '' WHEN k % 3 = 0 AND k < 16 THEN text || ' more' ELSE text END AS text FROM d),
f AS (SELECT *, {CLEAN_SQL} AS cleaned FROM e)
SELECT bundle || CASE k WHEN 17 THEN '.exe' WHEN 18 THEN '.docx' WHEN 19 THEN '.md' ELSE '.TXT' END AS name,
CASE WHEN k IN (16, 17, 18) OR cleaned = '' THEN 'failed' WHEN k % 3 = 0 THEN 'done' ELSE 'skipped' END AS status,
CASE WHEN k = 17 THEN 'unsupported type: exe' WHEN k = 18 THEN 'BadZipFile: File is not a zip file' WHEN cleaned = '' THEN 'no text' END AS error,
CASE WHEN k < 16 AND cleaned <> '' THEN length(cleaned) END AS n_chars FROM f""")
def file_ledger(g, t):
    """Files written, processed, some changed, processed again: those that changed are done anew, others skipped, failures tried and told again."""
    folder, bundles = scratch.folder(g.spark, "files"), _bundles(t)
    store = processing.FileStore(g.spark, f"{folder}/store", lambda df, c: embed_distinct(df, c, HashEmbedder(8)))
    processing.write_files(bundles, f"{folder}/in", "part")
    store.process(f"{folder}/in")
    changed = bundles.where("k % 3 = 0 AND k < 16")
    last = F.struct(F.lit(1).alias("at"), F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    more = changed.select("k", "name").distinct().select("k", "name", last.alias("part"), F.encode(F.lit(" more"), "UTF-8").alias("content"), F.lit(b"").alias("before"))
    processing.write_files(changed.unionByName(more), f"{folder}/in", "part")
    report = store.process(f"{folder}/in")
    length = F.when(~F.col("name").endswith(".md"), F.col("text_length"))
    return report.join(store.ledger().select("name", "text_length"), "name").select("name", "status", "error", length.alias("n_chars"))


class LetterEmbedder:
    """Counts of some letters: an embedder that SQL can follow."""

    letters = "aeiou"

    def embed(self, texts: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        return texts.withColumn(out, F.array(*[F.regexp_count(text, F.lit(x)).cast("float") for x in self.letters]))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{x}'))::BIGINT AS n_{x}" for x in LetterEmbedder.letters) + " FROM documents")
def embed_memo(g, t):
    """Each distinct text is embedded once, and each row gets its text's vector."""
    d = embed_distinct(t("documents").select("doc_id", "text"), "text", LetterEmbedder())
    return d.select("doc_id", *[F.col("embedding")[i].cast("long").alias(f"n_{x}") for i, x in enumerate(LetterEmbedder.letters)])


# Ingestion
@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_events(g, t):
    return I.latest(g.nodes("Event").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT coalesce(c.c_custkey, n.k) AS c_custkey, coalesce(n.bal, c.c_acctbal) AS c_acctbal, c.c_name FROM customer c
FULL JOIN (SELECT c_custkey * 2 AS k, c_acctbal + 1 AS bal FROM customer WHERE c_mktsegment = 'BUILDING') n ON c.c_custkey = n.k""")
def upsert_nodes(g, t):
    c = g.nodes("Customer").select("c_custkey", "c_acctbal", "c_name")
    new = t("customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") * 2).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return I.upsert_nodes(c, new, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0")
def delete_nodes(g, t):
    c = g.nodes("Customer")
    return I.delete_nodes(c, [], c.where("c_acctbal < 0"), "c_custkey")[0].select("c_custkey")


@query("SELECT o_orderkey AS src_id, o_custkey AS dst_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def detach_edges(g, t):
    c = g.nodes("Customer")
    return I.delete_nodes(c, [(g.edges("Order", "PLACED_BY", "Customer"), ("dst_id",))], c.where("c_acctbal < 0"), "c_custkey")[1][0]


@query("SELECT o_orderkey AS src_id, o_custkey AS dst_id FROM orders WHERE o_orderstatus <> 'F'")
def delete_edges(g, t):
    e = g.edges("Order", "PLACED_BY", "Customer")
    return I.delete_edges(e, _finished(t))


def _finished(t):
    """The edges that are there already: those of finished orders."""
    return t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("src_id"), F.col("o_custkey").alias("dst_id"))


@query("SELECT DISTINCT o_orderkey AS src_id, o_custkey AS dst_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 AND o_orderstatus <> 'F'")
def create_edges(g, t):
    e = g.edges("Order", "PLACED_BY", "Customer")
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    return I.create_edges(e, ids(t("orders"), "o_orderkey"), ids(t("customer").where("c_acctbal >= 0"), "c_custkey"), _finished(t))


@query("""SELECT count(*) AS checked, (count(*) FILTER (c_acctbal >= 0 AND o_orderstatus <> 'F'))::BIGINT AS created,
(count(*) FILTER (c_acctbal >= 0 AND o_orderstatus = 'F'))::BIGINT AS skipped, (count(*) FILTER (c_acctbal < 0))::BIGINT AS failed
FROM orders JOIN customer ON c_custkey = o_custkey""")
def sync_relationships(g, t):
    there = t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    status = I.edge_status(t("orders"), "o_orderkey", "o_custkey", there, _finished(t))
    return I.sync_summary(status)


@query("""WITH s AS (SELECT d.doc_id IS NOT NULL AS g, e.vec_id IS NOT NULL AS v FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT count(*) AS total, count(*) FILTER (g AND v) AS succeeded, count(*) FILTER (g <> v) AS partially_succeeded, count(*) FILTER (NOT g AND NOT v) AS failed FROM s""")
def ingest_summary(g, t):
    """Nodes and vectors that were ingested apart, row by row of either side."""
    return I.ingest_summary(I.ingest_status(t("documents"), t("embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id"))


@query("SELECT count(*) AS total, count(*) AS succeeded, 0::BIGINT AS partially_succeeded, 0::BIGINT AS failed FROM orders")
def order_summary(g, t):
    """Orders ingested: an entity without vectors succeeds in the graph alone. The counts are read back."""
    return dual.summary(_dual(g).ingest_batch("Order", t("orders")))


@query("SELECT doc_id, true AS in_graph, coalesce(text, '') <> '' AS in_vectors FROM documents")
def dual_ingest(g, t):
    """Documents ingested into nodes and vectors; the status is read back from both."""
    return _dual(g).ingest_batch("Document", t("documents")).select("doc_id", "in_graph", "in_vectors")


@query("SELECT DISTINCT md5(text || role) AS id, text AS question, role AS query FROM conversations")
def store_query(g, t):
    asked = t("conversations").select(F.col("text").alias("question"), F.col("role").alias("query"))
    memory = asked.withColumn("id", F.md5(F.concat("question", "query"))).select("id", "question", "query").limit(0)
    return I.store_query(memory, asked)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_upsert(g, t):
    """The events table as a change feed: what the stream leaves equals the batch's latest rows."""
    spark = g.spark
    source = t("events").inputFiles()[0].rsplit("/", 1)
    work = scratch.folder(spark, "stream")
    table = changes.LatestTable(spark, f"{work}/rows", t("events").schema, "user_id", ("ts", "event_id"))
    feed = spark.readStream.schema(table.schema).option("pathGlobFilter", "events*.parquet" if source[1].startswith("events") else "*.parquet").parquet(source[0])
    changes.stream_upsert(feed, table, f"{work}/checkpoint").awaitTermination()
    return table.read().select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
WHERE k = 1 AND event_type <> 'error'""")
def change_feed(g, t):
    """Events as row changes in five micro-batches: an error deletes its user's row, anything else writes it; late ones don't bring it back."""
    work, events = scratch.folder(g.spark, "feed"), t("events")
    # Dealt by a hash, so that batches come out of order: the newest change counts, not the last one.
    events.repartition(5, "event_id").write.parquet(f"{work}/in")
    table = ChangeTable(g.spark, f"{work}/table", "latest", events.schema, ("user_id",), ("ts", "event_id"), buckets=8, most_runs=3)
    feed = ChangeFeed(table, lambda: F.col("event_type") == "error")
    source = g.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    feed.follow(source, f"{work}/checkpoint").awaitTermination()
    return feed.read().select("user_id", "event_id", "event_type", "value")


def _dual(g, read=None):
    """Documents as entities with vectors, and the orders of customers as edges, in a store of their own."""
    outer = PropertyGraph(g.spark, read or g.read, [*g.entities.values()])
    return DualStore(g.spark, scratch.folder(g.spark, "dual"), outer, lambda df, c: embed_distinct(df, c, HashEmbedder(16)))


@query("""SELECT doc_id, coalesce(lang, 'xx') = 'en' AND coalesce(text, '') <> '' AS in_vectors, count(*) OVER () AS n_nodes FROM documents WHERE coalesce(lang, 'xx') IN ('en', 'de')""")
def dual_store(g, t):
    """Documents really ingested into nodes and vectors: all but French and Spanish ones; German ones are removed and come back without text."""
    d = t("documents")
    store = _dual(g, lambda n: d.limit(0) if n == "documents" else g.read(n))
    store.ingest_batch("Document", d.where("coalesce(lang, 'xx') IN ('en', 'de')"))
    german = d.where("lang = 'de'")
    store.remove("Document", german)
    store.ingest_batch("Document", german.withColumn("text", F.lit(None).cast("string")))
    nodes = store.nodes("Document")
    points = store.points("Document").select(F.col("vec_id").alias("_p"))
    total = nodes.agg(F.count("*").alias("n_nodes"))
    return nodes.join(points, F.col("doc_id") == F.col("_p"), "left").select("doc_id", F.col("_p").isNotNull().alias("in_vectors")).join(F.broadcast(total))


@query("""WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT NULL, text FROM documents WHERE lang = 'en')
SELECT count(*) AS total, count(*) FILTER (id IS NOT NULL AND coalesce(text, '') <> '') AS succeeded, count(*) FILTER (id IS NOT NULL AND coalesce(text, '') = '') AS partially_succeeded,
count(*) FILTER (id IS NULL) AS failed FROM d""")
def dual_summary(g, t):
    """The status of a batch, read back from what was committed; English documents come once more without an id."""
    d = t("documents")
    return dual.summary(_dual(g).ingest_batch("Document", d.unionByName(d.where("lang = 'en'").withColumn("doc_id", F.lit(None).cast("long")))))


@query("SELECT o_orderkey AS src_id, c_custkey AS dst_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 AND o_orderstatus <> 'P'")
def dual_edges(g, t):
    """Orders ingested with their edges; customers in debt and pending orders are removed with theirs."""
    store = _dual(g)
    store.ingest("Order", t("orders"))
    store.remove("Customer", t("customer").where("c_acctbal < 0"))
    store.remove("Order", t("orders").where("o_orderstatus = 'P'"))
    return store.edges("Order", "PLACED_BY", "Customer").select("src_id", "dst_id")
