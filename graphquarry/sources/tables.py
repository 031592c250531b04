"""The driver's tables as a property graph and a vector collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.plans.graph import PropertyGraph
from graphquarry.plans.model import EntityDef, RelDef, ScopeDef, VectorDef


def reader(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities() -> list[EntityDef]:
    rich = ScopeDef("rich", F.col("c_acctbal") > 5000, "customers with a large balance")
    indebted = ScopeDef("indebted", F.col("c_acctbal") < 0, "customers who owe money")
    return [
        EntityDef("Region", "region", "r_regionkey"),
        EntityDef("Nation", "nation", "n_nationkey", relationships=(RelDef("IN_REGION", "Region", "n_regionkey"),), aliases=("Country",)),
        EntityDef("Customer", "customer", "c_custkey", relationships=(RelDef("IN_NATION", "Nation", "c_nationkey"),), aliases=("Client", "Buyer"), scopes=(rich, indebted)),
        EntityDef("Supplier", "supplier", "s_suppkey", relationships=(RelDef("IN_NATION", "Nation", "s_nationkey"),), aliases=("Vendor",)),
        EntityDef("Part", "part", "p_partkey", aliases=("Product", "Item")),
        EntityDef("Order", "orders", "o_orderkey", relationships=(RelDef("PLACED_BY", "Customer", "o_custkey"),), aliases=("Purchase",)),
        EntityDef(
            "LineItem",
            "lineitem",
            "l_orderkey",
            relationships=(
                RelDef("OF_ORDER", "Order", "l_orderkey", {"quantity": "l_quantity"}),
                RelDef("OF_PART", "Part", "l_partkey", {"quantity": "l_quantity", "discount": "l_discount"}),
                RelDef("FROM_SUPPLIER", "Supplier", "l_suppkey"),
            ),
        ),
        EntityDef("Event", "events", "event_id"),
        EntityDef("Document", "documents", "doc_id", vector=VectorDef("documents", ("text",), ("lang", "source"))),
    ]


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(spark, reader(spark, sf_dir), entities())


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("embeddings")
