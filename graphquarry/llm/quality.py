"""Quality rules as a bitmask ledger (DataFrame operations only).

Every rule is evaluated once for a document. The ledger keeps the measurements and one bit for each failed
rule; a policy is a mask over those bits, so changing or versioning a policy, or asking what each rule
contributes, reads the narrow ledger and never the texts.

Defined cases: a null or empty text has no words and fails `few_words`; null in other columns has no
effect; repeated rows get a ledger row each; texts of any length are measured whole; an empty table gives
an empty ledger; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import WHITE, materialise, quoted, text_or_empty, word_array

WINDOW = 5

#: Rule name -> failing condition over the measurements. The position is the bit; only ever append.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "100 * n_symbols > 25 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 12 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "few_letters": "2 * n_ascii_nonletters > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of these rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = {
    ("web", 1): Policy("web", 1, (*BASE.rules, "many_symbols", "duplicate_lines", "long_words", "short_words")),
    ("web", 2): Policy("web", 2, tuple(RULES)),
}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements.

    Each step refers to an array of the step before more than once, which keeps Catalyst from inlining
    it into a lambda, where it would be computed again for each element.
    """
    text = text_or_empty("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    a = docs.select("doc_id", text.alias("_t"), word_array(text).alias("_w"), lines.alias("_l"))
    b = a.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.array_join("_w", "").alias("_joined"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    n = F.size("_h") - (WINDOW - 1)
    windows = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]),
    )
    gone = lambda pattern: F.char_length("_joined") - F.char_length(F.regexp_replace("_joined", pattern, ""))
    c = b.select(
        "doc_id", "n_words", "n_lines", "n_dup_lines",
        F.char_length("_joined").cast("long").alias("word_chars"),
        gone(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        gone(r"[A-Z]+").cast("long").alias("n_upper"),
        gone(r"[\x21-\x40\x5B-\x60\x7B-\x7E]+").cast("long").alias("n_ascii_nonletters"),
        windows.alias("_g"),
    )
    # Only texts with some repeated window have their windows sorted.
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    pairs = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = c.withColumn("_s", F.when(some, pairs)).drop("_g")
    same = lambda x, i, k: F.coalesce(F.get("_s", i + k)["h"] == x["h"], F.lit(False))
    found = F.filter("_s", lambda x, i: same(x, i, 1) | same(x, i, -1))
    e = d.withColumn("_p", F.array_sort(F.transform(found, lambda x: x["i"]))).drop("_s")
    # Windows in order: each adds the words beyond those that the one before has covered.
    steps = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), p - F.coalesce(F.get("_p", i - 1), F.lit(-WINDOW))))
    return e.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    ).drop("_p")


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, measurements and fail_bits; each rule is evaluated once."""
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in rules.items()), F.lit(0))
    return measure(docs).withColumn("fail_bits", bits.cast("long"))


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept if it were left out.

    The ledger shrinks to one row for each combination of bits before the rules are crossed with it.
    """
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules])
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return (
        masks.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            count(hit).alias("n_fail"),
            count(F.col("bits") == F.col("r.bit")).alias("n_fail_alone"),
            count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit").cast("long"))) == 0).alias("n_kept_without"),
        )
    )


def judge(docs: DataFrame, policy: Policy = POLICIES["web", 2]) -> DataFrame:
    """The stored ledger of docs with the verdict of a policy."""
    book = materialise(ledger(docs), "quality-ledger")
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    return apply_policy(book, policy).withColumn("base_failed", base)


def keep(docs: DataFrame, policy: Policy = POLICIES["web", 2]) -> DataFrame:
    """The rows of docs that the policy keeps. Each row is judged where it stands, so nothing is joined.

    The row number adds nothing to the bits, but keeps Catalyst from moving the filter below the arrays of
    measure(), where it would inline them into their lambdas.
    """
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc_id"), F.col("text"))
    nothing = F.least(F.monotonically_increasing_id(), F.lit(0))
    book = ledger(whole).withColumn("fail_bits", F.col("fail_bits").bitwiseOR(nothing))
    return apply_policy(book, policy).where("kept").select("doc_id.*")
