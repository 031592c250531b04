"""Redaction inside JSON trees, as Columns over VARIANT: by key, by pattern, to a depth."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphquarry.functions import text as X

# A key that holds one of these, in whatever case, has its value redacted.
SENSITIVE_KEYS = (
    "api_key",
    "apikey",
    "password",
    "passwd",
    "pwd",
    "secret",
    "token",
    "access_token",
    "accesstoken",
    "refresh_token",
    "refreshtoken",
    "private_key",
    "privatekey",
    "client_secret",
    "clientsecret",
    "db_password",
    "dbpassword",
    "redis_password",
    "redispassword",
)
# What stands for a redacted value, and for a tree that is too deep.
REDACTED = "***REDACTED***"
TOO_DEEP = "***MAX_DEPTH_REACHED***"
MAX_DEPTH = 5


def is_sensitive(key: Column) -> Column:
    low = F.lower(key)
    return reduce(lambda a, b: a | b, [low.contains(k) for k in SENSITIVE_KEYS])


def as_variant(text: str) -> Column:
    return F.to_variant_object(F.array(F.lit(text)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once, and once in the plan, however often use names it."""
    return F.transform(F.array(value), use)[0]


def walk(tree: Column, kind: Column, depth: int = 0, deepest: int = MAX_DEPTH) -> Column:
    """The tree, of which `kind` is the schema, with sensitive keys, strings and what lies too deep redacted.

    Objects and arrays are taken apart to (key, value) entries alike, so each level stands in the plan once.
    """
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    string = F.to_variant_object(F.array(once(F.try_variant_get(tree, "$", "string"), X.redact)))
    leaf = F.when(kind == "STRING", F.variant_get(string, "$[0]", "variant")).otherwise(tree)
    if depth >= deepest:
        return F.when(is_object | is_array, as_variant(TOO_DEEP)).otherwise(leaf)
    pair = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    of_object = F.transform(F.map_entries(F.try_variant_get(tree, "$", "map<string,variant>")), lambda e: pair(e["key"], e["value"]))
    of_array = F.transform(F.try_variant_get(tree, "$", "array<variant>"), lambda v: pair(F.lit(None).cast("string"), v))
    hidden = F.variant_get(as_variant(REDACTED), "$[0]", "variant")
    below = F.transform(
        F.when(is_object, of_object).otherwise(of_array),
        lambda e: pair(e["key"], F.when(F.coalesce(is_sensitive(e["key"]), F.lit(False)), hidden).otherwise(once(F.schema_of_variant(e["value"]), lambda k: walk(e["value"], k, depth + 1, deepest)))),
    )
    rebuilt = once(below, lambda es: F.when(is_object, F.to_variant_object(F.map_from_entries(es))).otherwise(F.to_variant_object(F.transform(es, lambda e: e["value"]))))
    return F.when(is_object | is_array, rebuilt).otherwise(leaf)


def redact_json(json: Column, deepest: int = MAX_DEPTH) -> Column:
    """JSON text redacted as a tree, its keys in order; text that isn't JSON is redacted as a string; null stays null."""
    tree = F.try_parse_json(json)
    return F.coalesce(F.to_json(once(tree, lambda v: F.when(v.isNotNull(), once(F.schema_of_variant(v), lambda kind: walk(v, kind, 0, deepest))))), X.redact(json))
