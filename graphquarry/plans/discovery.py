"""Discovery: from schemas to configuration. Runs over names and types alone, without a Spark job."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from graphquarry.operators.ingest import SECRET_NAMES
from graphquarry.plans.graph import Hop
from graphquarry.plans.model import EntityDef, RelDef, ScopeDef

# Names of columns that hold text.
TEXT_NAMES = ("description", "bio", "notes", "content", "body", "summary", "details", "comment", "message", "text", "remarks")
# Names of columns that are embedded, and of those that aren't.
EMBEDDED_NAMES = ("name", "description", "bio", "notes", "content", "body", "summary", "details", "comment", "message", "text", "remarks", "about", "overview", "introduction")
NOT_EMBEDDED = ("_id", "_at", "_on", "password", "token", "secret", "key", "hash", "salt", "uuid", "guid")
# What business terms are also called.
SYNONYMS = {
    "customer": ("client", "buyer", "patron", "account"),
    "user": ("member", "person", "individual", "account"),
    "order": ("purchase", "sale", "transaction"),
    "product": ("item", "good", "merchandise", "article"),
    "invoice": ("bill", "statement", "receipt"),
    "payment": ("transaction", "remittance"),
    "employee": ("worker", "staff", "personnel", "team member"),
    "company": ("organization", "business", "enterprise", "firm"),
    "address": ("location", "place"),
    "phone": ("telephone", "contact number", "mobile"),
    "email": ("e-mail", "electronic mail", "contact"),
    "category": ("type", "class", "group"),
    "tag": ("label", "keyword"),
    "comment": ("note", "remark", "feedback"),
    "post": ("article", "entry", "content"),
    "file": ("document", "attachment", "upload"),
    "image": ("photo", "picture", "graphic"),
    "team": ("group", "department", "division"),
    "role": ("position", "title", "function"),
    "permission": ("access", "right", "privilege"),
}
# Descriptions of common properties, and of those with a speaking ending or beginning.
DESCRIPTIONS = {
    "id": "Unique identifier",
    "created_at": "Creation timestamp",
    "updated_at": "Last update timestamp",
    "deleted_at": "Deletion timestamp (soft deletes)",
    "email": "Email address",
    "name": "Name",
    "status": "Status",
    "type": "Type",
    "description": "Description",
    "notes": "Notes",
    "total": "Total amount",
    "quantity": "Quantity",
    "price": "Price",
    "amount": "Amount",
    "date": "Date",
    "timestamp": "Timestamp",
}
ENDINGS = {"_id": "Foreign key to {}", "_at": "{} timestamp", "_on": "{} date", "_count": "Count of {}"}
BEGINNINGS = {"is_": "Flag indicating if {}", "has_": "Flag indicating has {}"}
DISCRIMINATORS = ("role_type", "type", "status", "kind", "category", "role")


def plural(word: str) -> str:
    irregular = {"person": "people", "child": "children"}
    if word in irregular:
        return irregular[word]
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search(r"(s|x|z|ch|sh)$", word) else "s")


def singular(word: str) -> str:
    if word == "people":
        return "person"
    if word.endswith("ies"):
        return word[:-3] + "y"
    if re.search(r"(s|x|z|ch|sh)es$", word):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def is_identifier(name: str) -> bool:
    return len(name) <= 255 and re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) is not None


def column_types(schema: StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def text_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, StringType) and any(p in f.name.lower() for p in TEXT_NAMES)]


def embed_fields(schema: StructType) -> list[str]:
    """Text columns with an embedded name and no excluded one; then further string columns with an embedded name, excluded or not."""
    low = {c: c.lower() for c in schema.names}
    named = lambda c, names: any(p in low[c] for p in names)
    first = [c for c in text_columns(schema) if named(c, EMBEDDED_NAMES) and not named(c, NOT_EMBEDDED)]
    strings = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    return first + [c for c in strings if c not in first and named(c, EMBEDDED_NAMES)]


def properties(schema: StructType) -> list[str]:
    return [c for c in schema.names if not any(s in c.lower() for s in SECRET_NAMES)]


def foreign_keys(table: str, schemas: dict[str, StructType]) -> list[tuple[str, str, str]]:
    """(column, table, column): stem_id -> plural(stem).id, or x_thing -> y_thing where y_thing is another table's first column."""
    out = []
    heads = {}  # orderkey -> (orders, o_orderkey): the table whose name begins like its key
    for t, s in schemas.items():
        stem = s.names[0].split("_", 1)[-1] if s.names else ""
        if stem.endswith("key") and t.startswith(stem[:-3]):
            heads[stem] = (t, s.names[0])
    for c in schemas[table].names:
        if c.endswith("_id") and plural(c[:-3]) in schemas:
            out.append((c, plural(c[:-3]), "id"))
        stem = c.split("_", 1)[-1]
        if "_" in c and stem in heads and heads[stem][0] != table:
            out.append((c, *heads[stem]))
    return out


def aliases(label: str) -> list[str]:
    one = snake(label).replace("_", " ")
    names = [one, plural(one), one.replace(" ", "")]
    for s in SYNONYMS.get(one, ()):
        names += [s, plural(s)]
    return list(dict.fromkeys(names))


def title(name: str) -> str:
    return name.replace("_", " ").title()


def describe(column: str) -> str:
    if column in DESCRIPTIONS:
        return DESCRIPTIONS[column]
    for end, text in ENDINGS.items():
        if column.endswith(end):
            return text.format(title(column[: -len(end)]))
    for begin, text in BEGINNINGS.items():
        if column.startswith(begin):
            return text.format(title(column[len(begin) :]))
    return title(column)


def label_of(table: str) -> str:
    return "".join(w.title() for w in singular(table).split("_"))


def discover(table: str, schemas: dict[str, StructType], found: list[tuple[str, str, str]] | None = None, key: str | None = None) -> EntityDef:
    """An entity for a table: properties, and a relationship for each foreign key.

    found: the foreign keys (column, table, column) and key the id column, if they are known from rows; else names tell them.
    """
    links = foreign_keys(table, schemas) if found is None else found
    rels = tuple(RelDef(f"BELONGS_TO_{re.sub('_id$', '', c).upper()}", label_of(t), c) for c, t, _ in links)
    names = schemas[table].names
    key = key or ("id" if "id" in names else names[0])
    label = label_of(table)
    return EntityDef(label, table, key, tuple(properties(schemas[table])), rels, None, tuple(aliases(label)))


def traversal_scopes(graph, label: str, hop, values: dict[str, str]) -> list[ScopeDef]:
    """Scopes from a discriminator of related rows: value -> scope name, each a semi-join."""
    field = next((d for d in DISCRIMINATORS if d in graph.nodes(hop.target).columns), None)
    if field is None:
        return []
    make = lambda v: lambda df: graph.related(label, [replace(hop, where=F.col(field) == v)], df)
    return [ScopeDef(name, make(v), f"{label} with {field} {v}") for v, name in values.items()]


def inverse(entity: EntityDef, rel: RelDef) -> str:
    """The name of a relationship seen from its target: HAS_ and the source in plural."""
    return f"HAS_{plural(snake(entity.label)).upper()}"


def inverse_hops(entities: list[EntityDef]) -> dict[str, dict[str, Hop]]:
    """label -> name -> step against a relationship that points to the label. Of several of one name the first stays."""
    out: dict[str, dict[str, Hop]] = {}
    for e in entities:
        for r in e.relationships:
            out.setdefault(r.target, {}).setdefault(inverse(e, r), Hop(r.type, e.label, "incoming"))
    return out


def enabled(entity: bool | None, operation: bool | None, everywhere: bool = True) -> bool:
    """Whether a row event is followed: the entity's word counts before the operation's, and that before the general one."""
    return next((x for x in (entity, operation) if x is not None), everywhere)
