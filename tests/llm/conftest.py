import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column for each name that an operator uses itself.
CLASHES = ("n_words", "kept", "fail_bits", "size", "taken", "fp", "component_id", "items", "spans", "n_hit", "start", "lang_pred", "base", "verdict", "tokens", "batch", "first", "key", "bands", "copies", "before", "target", "source_size", "text_hash", "place", "_text", "_n_words", "_spans", "_items", "_n_hit", "_doc", "_row", "_id", "_copy", "_copies", "_h", "_t", "_w", "_l")


@pytest.fixture(scope="session")
def make(spark):
    """docs from (doc_id, text[, lang[, source]]) rows, with further columns of clashing names."""
    from pyspark.sql import functions as F

    def build(rows, clashes=True):
        full = [(*r, *("en", "src0")[len(r) - 2 :], None)[:5] for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df

    return build


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here\nsecond line of this very text", "en", "a"),
    (2, None, None, None),
    (3, "", "fr", "b"),
    (4, " \t\n\x0b ", "de", "a"),
    (5, LONG, "en", "a"),
    (6, "the quick brown fox jumps over the lazy dog and runs far away from here\nsecond line of this very text", "en", "a"),
    (6, "the quick brown fox jumps over the lazy dog and runs far away from here\nsecond line of this very text", "en", "a"),
    (None, "a row without an identifier but with some words in it, more than ten of them", "en", None),
    (None, None, None, None),
    (7, "Été à la plage, ñandú über straße 😀 İstanbul", "fr", "c"),
    (-8, "one", "en", "c"),
]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
