"""Context for a question: which entities it names, which part of the schema matters, what that costs."""

from __future__ import annotations

from math import ceil

from graphquarry.plans.graph import PropertyGraph


def detect(graph: PropertyGraph, question: str) -> dict[str, list[str]]:
    """label -> named scopes, for entities whose label, alias or scope stands in the question."""
    low, out = question.lower(), {}
    for e in graph.entities.values():
        scopes = [s.name for s in e.scopes if s.name.replace("_", " ").lower() in low]
        if scopes or any(n.lower() in low for n in (e.label, *e.aliases)):
            out[e.label] = scopes
    return out


def relevant_schema(graph: PropertyGraph, labels: set[str]) -> dict:
    """The labels, relationships between or from them, ends included, and properties."""
    rels = [(e.label, r.type, r.target) for e in graph.entities.values() for r in e.relationships if e.label in labels or r.target in labels]
    ends = {x for s, _, t in rels for x in (s, t) if s in labels or t in labels} | {x for x in labels if x in graph.entities}
    props = {x: list(graph.entities[x].properties or graph.nodes(x).columns) for x in sorted(ends & graph.entities.keys())}
    return {"labels": sorted(ends), "relationships": rels, "properties": props}


def tokens(text: str) -> int:
    n = ceil(len(text) / 4)
    return ceil(n * 1.2) if text[:1] in ("{", "[") else n


def compression(selected: int, total: int) -> float:
    return round(1 - selected / total, 3) if total else 0.0


def overall_score(scores: list[float]) -> float:
    return round(sum(scores) / len(scores), 3) if scores else 0.0


def confidence(graph: PropertyGraph, text: str, limited: bool) -> float:
    named = sum(x.lower() in text.lower() for x in graph.entities)
    return min(1.0, round(0.5 + 0.1 * named + 0.1 * limited, 2))
