"""Question templates: a few sentence forms become plans, without any model."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.plans.graph import Hop, PropertyGraph
from graphquarry.plans.predicates import compare

TEMPLATES = (
    ("count", re.compile(r"^(?:how many|count|number of)\s+(?P<label>[\w ]+?)\??$", re.I)),
    ("aggregation", re.compile(r"^(?P<function>average|avg|sum|total|minimum|min|maximum|max)\s+(?:of\s+)?(?P<property>\w+)\s+(?:of|for)\s+(?P<label>\w+)\??$", re.I)),
    ("filtering", re.compile(r"^(?:show|list|find|get)\s+(?:all\s+)?(?P<label>\w+)\s+(?:where|with)\s+(?P<property>\w+)\s*(?P<operator>>=|<=|<>|!=|=|>|<)\s*(?P<value>\S+)$", re.I)),
    ("find_by_property", re.compile(r"^(?:show|list|find|get)\s+(?:all\s+)?(?P<label>\w+)\s+(?:where|with)\s+(?P<property>\w+)\s+(?:is\s+)?(?P<value>\S+)$", re.I)),
    ("relationship_query", re.compile(r"^(?:show|list|find|get)\s+(?:all\s+)?(?P<label>\w+)\s+and\s+(?:their|its)\s+(?P<other>\w+)$", re.I)),
    ("list_all", re.compile(r"^(?:show|list|find|get|display)\s+(?:me\s+)?(?:all\s+)?(?P<label>[\w ]+?)\??$", re.I)),
)
FUNCTIONS = {"average": F.avg, "avg": F.avg, "sum": F.sum, "total": F.sum, "minimum": F.min, "min": F.min, "maximum": F.max, "max": F.max}


def detect(question: str) -> tuple[str, dict[str, str]] | None:
    for name, form in TEMPLATES:
        if m := form.match(question.strip()):
            return name, m.groupdict()
    return None


def find_label(graph: PropertyGraph, word: str) -> tuple[str, str | None]:
    """(label, scope) for a word or "scope word"; labels and aliases are compared without case and plural s."""
    plain = lambda w: w.lower()[:-1] if w.lower().endswith("s") else w.lower()
    *front, last = word.split()
    for e in graph.entities.values():
        if plain(last) in {plain(x) for x in (e.label, *e.aliases)}:
            scope = next((s.name for s in e.scopes if s.name == "_".join(front).lower()), None)
            if front and scope is None:
                break
            return e.label, scope
    raise KeyError(f"no entity for {word!r}")


def literal(value: str):
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip("'\"")


def answer(graph: PropertyGraph, question: str, limit: int | None = None) -> DataFrame:
    """The rows that a question asks for: all of them, or no more than a given limit."""
    rows = _plan(graph, question)
    return rows if limit is None else rows.limit(limit)


def _plan(graph: PropertyGraph, question: str) -> DataFrame:
    found = detect(question)
    if found is None:
        raise ValueError(f"no template for {question!r}")
    name, p = found
    label, scope = find_label(graph, p["label"])
    rows = graph.nodes(label)
    if scope:
        rows = next(s for s in graph.entity(label).scopes if s.name == scope).apply(rows)
    if name == "count":
        return rows.agg(F.count("*").alias("count"))
    if name == "aggregation":
        return rows.agg(FUNCTIONS[p["function"].lower()](p["property"]).alias("result"))
    if name in ("filtering", "find_by_property"):
        return rows.where(compare(p["property"], p.get("operator") or "=", literal(p["value"])))
    if name == "relationship_query":
        other, _ = find_label(graph, p["other"])
        for direction, source, target in (("outgoing", label, other), ("incoming", other, label)):
            for r in graph.entity(source).relationships:
                if r.target == target:
                    return graph.traverse(label, [Hop(r.type, other, direction)])
        raise KeyError(f"{label} and {other} are not related")
    return rows
