"""The secrets model on sources that it was not trained on."""

import importlib.util
from pathlib import Path

import pytest

from graphquarry.llm import secrets


@pytest.fixture(scope="module")
def ratios():
    """The model of an empty table: what documents add can't help it."""
    return secrets.log_ratios(secrets.tally(secrets.random_strings()), secrets.ordinary_table())


def tokens(package):
    root = Path(importlib.util.find_spec(package).origin).parent
    return {t for p in sorted(root.rglob("*.py"))[:400] for t in secrets.CANDIDATE.findall(p.read_text("utf-8", "ignore"))}


@pytest.mark.parametrize("package", ["pandas", "pyarrow", "pyspark"])
def test_identifiers_of_other_libraries_are_ordinary(ratios, package):
    """Over 99 % of the long tokens of libraries that taught it nothing."""
    found = tokens(package)
    flagged = [t for t in found if secrets.ratio(t, ratios) > secrets.BAR]
    assert len(found) > 1500 and len(flagged) < 0.01 * len(found), flagged[:20]


def test_names_and_compounds(ratios):
    names = ("PyLong_AsUnsignedLong", "ssl_handshake_timeout", "allow_broadcast=None", "assertAnnotationEqual", "Rechtsschutzversicherungsgesellschaften", "abcdefghijklmnopqrstuvwxyz", "anticonstitucionalmente")
    assert [n for n in names if secrets.ratio(n, ratios) > secrets.BAR] == []


def test_random_strings_are_found(ratios):
    strings = [s for s in secrets.random_strings(3000, seed=991) if secrets.CANDIDATE.fullmatch(s)]
    assert sum(secrets.ratio(s, ratios) > secrets.BAR for s in strings) > 0.95 * len(strings)


def test_half_of_the_library_is_left_out():
    assert 10_000 < len(secrets.code_words()) and len(secrets.code_words(5)) < 5_000
