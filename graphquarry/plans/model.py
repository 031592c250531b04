"""Declarations: how tables become entities, relationships, scopes and vector collections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


def _needed(value, what: str) -> None:
    if not value:
        raise ValueError(f"{what} must not be empty")


@dataclass(frozen=True)
class RelDef:
    """A directed relationship, source -> target, held by a foreign key of the source's table (a virtual edge)."""

    type: str
    target: str
    foreign_key: str
    properties: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for value, what in ((self.type, "relationship type"), (self.target, "target label"), (self.foreign_key, "foreign key")):
            _needed(value, what)


@dataclass(frozen=True)
class VectorDef:
    collection: str
    embed_fields: tuple[str, ...]
    metadata: tuple[str, ...] = ()

    def __post_init__(self):
        _needed(self.collection, "collection")
        _needed(self.embed_fields, "embed fields")


@dataclass(frozen=True)
class ScopeDef:
    """A named business predicate: a Column, or a DataFrame -> DataFrame step where related rows decide."""

    name: str
    predicate: Column | Callable[[DataFrame], DataFrame]
    concept: str = ""
    examples: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate) if isinstance(self.predicate, Column) else self.predicate(df)


@dataclass(frozen=True)
class EntityDef:
    label: str
    table: str
    id: str
    properties: tuple[str, ...] = ()
    relationships: tuple[RelDef, ...] = ()
    vector: VectorDef | None = None
    aliases: tuple[str, ...] = ()
    scopes: tuple[ScopeDef, ...] = ()

    def __post_init__(self):
        for value, what in ((self.label, "label"), (self.table, "table"), (self.id, "id column")):
            _needed(value, what)

    @classmethod
    def from_config(cls, label: str, config: dict) -> EntityDef:
        """From a nested mapping; a relationship without a foreign key is left out."""
        graph = config.get("graph", {})
        rels = tuple(
            RelDef(r["type"], r["target_label"], r["foreign_key"], dict(r.get("properties", {})))
            for r in graph.get("relationships", ())
            if r.get("foreign_key")
        )
        vector = config.get("vector")
        return cls(
            graph.get("label", label),
            config["table"],
            config.get("id", "id"),
            tuple(graph.get("properties", ())),
            rels,
            VectorDef(vector["collection"], tuple(vector["embed_fields"]), tuple(vector.get("metadata", ()))) if vector else None,
            tuple(config.get("metadata", {}).get("aliases", ())),
        )


def merge_config(found: dict, stated: dict, depth: int = 10) -> dict:
    """What is stated over what was discovered, maps recursively, to a bounded depth."""
    out = dict(found)
    for k, v in stated.items():
        both = isinstance(v, dict) and isinstance(out.get(k), dict) and depth > 0
        out[k] = merge_config(out[k], v, depth - 1) if both else v
    return out
