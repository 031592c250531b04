"""Query patterns: parametric plans over a property graph. The registry is open to further ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.plans.graph import Hop, PropertyGraph
from graphquarry.plans.predicates import compare, temporal

REGISTRY: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}


def pattern(*needed: str):
    def register(f):
        REGISTRY[f.__name__] = (needed, f)
        return f

    return register


def run(name: str, graph: PropertyGraph, **params) -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"unknown pattern {name}")
    needed, f = REGISTRY[name]
    if missing := [p for p in needed if p not in params]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return f(graph, **params)


@pattern("entity", "property", "operator", "value")
def property_filter(graph, entity, property, operator, value):
    return graph.nodes(entity).where(compare(property, operator, value))


@pattern("entity", "property", "min_value", "max_value")
def property_range(graph, entity, property, min_value, max_value):
    return graph.nodes(entity).where(F.col(property).between(min_value, max_value))


@pattern("start_entity", "path")
def relationship_traversal(graph, start_entity, path, return_distinct=True):
    """path: Hops, each with its own filter. Distinct start rows come from semi-joins."""
    return graph.related(start_entity, path) if return_distinct else graph.traverse(start_entity, path)


@pattern("entity", "relationship", "target_entity")
def entity_with_relationship(graph, entity, relationship, target_entity, direction="incoming", where=None):
    return graph.related(entity, [Hop(relationship, target_entity, direction, where)])


@pattern("entity", "relationship", "target_entity")
def entity_without_relationship(graph, entity, relationship, target_entity, direction="incoming", where=None):
    return graph.unrelated(entity, [Hop(relationship, target_entity, direction, where)])


AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


@pattern("base_entity", "relationship", "related_entity", "aggregate_property", "aggregate_function", "operator", "value")
def entity_with_aggregated_relationship(
    graph, base_entity, relationship, related_entity, aggregate_property, aggregate_function, operator, value, direction="incoming", alias="aggregate"
):
    """operator: a comparison, or between with a pair of bounds."""
    agg = AGGREGATES[aggregate_function](aggregate_property)
    out = graph.aggregate_related(base_entity, Hop(relationship, related_entity, direction), **{alias: agg})
    return out.where(F.col(alias).between(*value) if operator == "between" else compare(alias, operator, value))


@pattern("entity", "property", "operator")
def temporal_filter(graph, entity, property, operator, **bounds):
    return graph.nodes(entity).where(temporal(property, operator, **bounds))


@pattern("start_entity", "hops")
def multi_hop_traversal(graph, start_entity, hops, where=None):
    return graph.traverse(start_entity, hops, where)


@pattern("entity", "filters")
def multiple_property_filter(graph, entity, filters, combine="AND"):
    """filters: (property, operator, value) triples."""
    columns = [compare(*f) for f in filters]
    join = (lambda a, b: a & b) if combine.upper() == "AND" else (lambda a, b: a | b)
    return graph.nodes(entity).where(reduce(join, columns))


@pattern("entity", "filters", "relationship", "target_entity")
def relationship_with_property_filter(graph, entity, filters, relationship, target_entity, direction="incoming", where=None):
    rows = multiple_property_filter(graph, entity, filters)
    return graph.related(entity, [Hop(relationship, target_entity, direction, where)], rows)


@pattern("parts", "combine", "key")
def compose(graph, parts: list[DataFrame], combine: str, key: str):
    """AND: rows of the first that all others hold, by key. OR and UNION: rows of any, once for each key."""
    if combine.upper() == "AND":
        return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), parts)
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates([key])


def apply_scopes(df: DataFrame, scopes) -> DataFrame:
    """Scopes are joined by AND."""
    return reduce(lambda d, s: d.where(s) if isinstance(s, Column) else s.apply(d), scopes, df)
