"""Redaction of JSON trees against a walk in Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from graphquarry.functions import text as X
from graphquarry.functions.redaction import SENSITIVE_KEYS, redact_json


def string(s):
    for find, put in X.SECRETS:
        s = re.sub(find, re.sub(r"\$(\d)", r"\\\1", put), s)
    return s


def walk(v, depth=0):
    if isinstance(v, (dict, list)) and depth >= 5:
        return ["***MAX_DEPTH_REACHED***"]
    if isinstance(v, dict):
        return {k: "***REDACTED***" if any(s in k.lower() for s in SENSITIVE_KEYS) else walk(x, depth + 1) for k, x in v.items()}
    if isinstance(v, list):
        return [walk(x, depth + 1) for x in v]
    return string(v) if isinstance(v, str) else v


def tree(rng, depth=0):
    kind = rng.random()
    if depth < 8 and kind < 0.35:
        keys = ["name", "apiKey", "Password_hash", "n", "mytoken", "list", "é", "secretary", "plain"]
        return {rng.choice(keys): tree(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 8 and kind < 0.6:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 17, -3, "text", "pwd: hunter22", "//user:pass@host", "Bearer " + "x" * 30, "", "sk-" + "a" * 48])


@pytest.mark.parametrize("seed", range(2))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    trees = [tree(rng) for _ in range(150)] + [{"a": [[[[[["deep"]]]]]]}, {"a": {"b": {"c": {"d": {"token": {"e": 1}}}}}}]
    df = spark.createDataFrame([(i, json.dumps(t, ensure_ascii=False)) for i, t in enumerate(trees)], "i int, j string")
    for r in df.select("i", redact_json(F.col("j")).alias("r")).collect():
        assert json.loads(r.r) == walk(trees[r.i])


def test_what_is_no_json(spark):
    df = spark.createDataFrame([("{broken password=abcdef",), (None,), ("",), ("plain",)], "j string")
    assert [r[0] for r in df.select(redact_json(F.col("j"))).collect()] == ["{broken password=***REDACTED***", None, "", "plain"]
