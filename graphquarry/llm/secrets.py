"""Secret scans: stated patterns, and character Markov models for what the patterns miss.

Two models of order 2 are trained: one of random strings, one of ordinary identifiers. A candidate (a
long token of key characters outside all base spans) is a secret if its log-likelihood ratio a
character is above BAR. The labelled samples: random strings are generated over the alphabets and layouts of
keys, together with the values that the base patterns find in a sample of about TRAIN_DOCS documents; ordinary ones are
generated names, paths, UUIDs, dates, numbers and rulers, the names and words in source files of Python's own library (half of its
files, CODE_FILES at most; they weigh as much as what is generated), and all other long tokens of the same documents. What
documents add weighs DOCS_WEIGHT of that. From the documents the driver gets counts of three
characters in a row, which the alphabet bounds, whatever the documents hold.

Spans are code points, end exclusive, of the whole match. Defined cases: a null or empty text has none; overlapping spans of
different base kinds all stay, a model span that meets a base span is not added; repeated rows get equal spans; texts of any
length are scanned whole; an empty table trains on generated strings alone; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
import sysconfig
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import hash_unit

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

#: Log-likelihood ratio a character: chosen on generated strings and names of another seed (README has the figures).
BAR = 0.15
TRAIN_DOCS = 2000
DOCS_WEIGHT = 0.1
GENERATED = 6000
#: Source files that teach ordinary names; where Python comes without sources, the generated ones do alone.
CODE_FILES = 400
ALPHABET = string.ascii_letters + string.digits + "+/_=-."
#: So many sightings weigh as much as what the shorter context says.
LEAN = 4.0

# Common words of names in code and in file paths.
NAME_WORDS = (
    "abstract access account action active adapter address admin api app application archive array assets async auth author backend "
    "backup base batch bean bin block buffer build builder bundle button cache callback category channel check class client cluster code "
    "collection color column command common component config connection console container content context controller count create current "
    "custom data database date debug default delete demo deploy detail device dialog dist document domain download driver element email "
    "enable encoding engine entity entry error event example exception export factory feature field file filter first folder format frame "
    "function gateway generator global graph group handler header height helper home host icon id image index info init input install "
    "instance interface internal invalid item iterator java job json key label last layout level lib library limit linux list listener "
    "loader local locale location lock log login main manager map master max media memory menu message meta method metrics migration min "
    "model module monitor name network node null number object offset option order output package page parent parser password path pattern "
    "payment platform plugin pool port process product profile project property protocol provider proxy public python query queue read record "
    "registry release remote render report request resource response result role root route rule runtime sample schema scope script search "
    "security select server service session setting singleton site size source stack state status storage store stream string style system table "
    "target task template test text theme thread time title token tool tracker transaction type unicode unit update upload user util valid value "
    "vendor version view web widget width window worker write"
).split()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    low = text.lower()  # may fold more than A-Z: good enough to leave most texts at once
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


#: Places in the tables: 0 is the start of a token.
PLACE = {c: i + 1 for i, c in enumerate(ALPHABET)}
SIDE = len(ALPHABET) + 1


def codes(token: str) -> list[int]:
    """For each character, the place of (the two before it, itself) in a table."""
    x, y, out = 0, 0, []
    for c in token:
        z = PLACE[c]
        out.append((x * SIDE + y) * SIDE + z)
        x, y = y, z
    return out


def tally(tokens: Iterable[str]) -> np.ndarray:
    return np.bincount([c for t in tokens for c in codes(t)], minlength=SIDE**3).astype(float)


def code_words(files: int = CODE_FILES) -> set[str]:
    """Distinct words and names in sources of Python's library: those whose path has an even checksum, no tests, first by checksum."""
    root = Path(sysconfig.get_paths()["stdlib"])
    known = {zlib.crc32(p.relative_to(root).as_posix().encode()): p for p in root.rglob("*.py") if not {"site-packages", "test", "tests"} & set(p.relative_to(root).parts)}
    chosen = [known[c] for c in sorted(known) if c % 2 == 0][:files]
    return {w for p in chosen for w in WORD.findall(p.read_text("utf-8", "ignore"))}


#: Filled once in a driver's life.
_ORDINARY: dict[str, np.ndarray] = {}


def ordinary_table() -> np.ndarray:
    if not _ORDINARY:
        made, read = tally(ordinary_names()), tally(sorted(code_words()))
        _ORDINARY["table"] = made + read * (made.sum() / read.sum() if read.sum() else 0)
    return _ORDINARY["table"]


def chances(table: np.ndarray) -> np.ndarray:
    """P(character | the two before it); a context that was seen little leans on the shorter one, at last on an even chance."""
    seen = table.reshape(SIDE, SIDE, SIDE)
    p = np.full(SIDE, 1 / len(ALPHABET))
    for counts in (seen.sum((0, 1)), seen.sum(0), seen):
        p = (counts + LEAN * p) / (counts.sum(-1, keepdims=True) + LEAN)
    return p


def log_ratios(random_table: np.ndarray, ordinary_table: np.ndarray) -> np.ndarray:
    """log P(random) - log P(ordinary), by place; rounded, so that the order of sums can't show."""
    return np.round(np.log(chances(random_table) / chances(ordinary_table)), 5).ravel()


def ratio(token: str, ratios: np.ndarray) -> float:
    return float(ratios[codes(token)].sum()) / len(token)


def random_strings(n: int = GENERATED, seed: int = 5) -> list[str]:
    """Keys as they are usually written: over some alphabet, at times behind a short prefix or with padding."""
    rng = random.Random(seed)
    base62 = string.ascii_letters + string.digits
    kinds = [base62, base62 + "+/", base62 + "_-", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", "0123456789ABCDEF"]
    out = []
    for i in range(n):
        s = "".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(20, 64)))
        if i % 5 == 0:
            s = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 4))) + rng.choice("_-") + s
        elif i % 5 == 1:
            s += "=" * rng.randint(1, 2)
        out.append(s)
    return out


def ordinary_names(n: int = GENERATED, seed: int = 6) -> list[str]:
    """Names, paths, UUIDs, dates, numbers and rulers of 20 characters or more."""
    rng = random.Random(seed)
    number = lambda: str(rng.choice((rng.randint(0, 9), rng.randint(10, 99), rng.randint(1990, 2030), rng.randint(0, 10**6))))
    words = lambda: [rng.choice(NAME_WORDS) if rng.random() < 0.88 else rng.choice((number(), rng.choice(NAME_WORDS) + number(), "v" + number())) for _ in range(rng.randint(2, 7))]
    date = lambda sep: sep.join((str(rng.randint(1990, 2030)), f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    kinds = [
        lambda: "".join(w.capitalize() for w in words()),
        lambda: (w := "".join(x.capitalize() for x in words()))[0].lower() + w[1:],
        lambda: "_".join(words()),
        lambda: "-".join(words()),
        lambda: "_".join(words()).upper(),
        lambda: "/" * rng.randint(0, 1) + "/".join(rng.choice(("_", "-", "")).join(words()[:2]) for _ in range(rng.randint(2, 6))),
        lambda: "/".join(words()),
        lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)),
        lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)).upper(),
        lambda: "_".join((rng.choice(NAME_WORDS).upper(), date(rng.choice(("", "-"))), number() + number())),
        lambda: "/".join((date("/"), rng.choice(NAME_WORDS), "-".join(words()))),
        lambda: "".join(rng.choices("0123456789", k=rng.randint(20, 40))),
        lambda: "-".join(number() for _ in range(8)),
        lambda: rng.choice("-=_+/") * rng.randint(20, 80),
        lambda: "".join(rng.choice(("-=", "+-", "=-=", "_/")) * 12),
        lambda: "=".join(("_".join(words()), number())) + "_" + rng.choice(NAME_WORDS),
    ]
    out: list[str] = []
    while len(out) < n:
        s = kinds[len(out) % len(kinds)]()
        while len(s) < 20:
            s += rng.choice("_-/") + rng.choice(NAME_WORDS)
        out.append(s)
    return out


def samples(text: str) -> tuple[set[str], set[str]]:
    """Labelled tokens of one text: values inside base spans, and tokens outside."""
    spans = base_spans(text)
    secret = {m[2] for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8}
    secret.update(text[start:end] for start, end, kind in spans if kind != "assign")
    plain, at = set(), 0
    for start, end, _ in [*spans, (len(text), len(text), "")]:
        if start > at:
            plain.update(WORD.findall(text, at, start))
        at = max(at, end)
    return secret, plain


def train(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> np.ndarray:
    """The log ratios, from generated strings and a sample of about n_docs documents, drawn by a hash of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = np.zeros((2, SIDE**3))
            for t in b.column(0):
                for table, tokens in zip(tables, samples(t.as_py() or "")):
                    np.add.at(table, [c for x in tokens for c in codes(x)], 1)
            kind, code = np.nonzero(tables)
            columns = [pa.array(kind, pa.int32()), pa.array(code, pa.int32()), pa.array(tables[kind, code].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "code", "n"])

    known = docs.where(F.col("doc_id").isNotNull())
    chosen = known.where(hash_unit("doc_id") < n_docs / max(1, known.count())).select("text")
    counts = chosen.mapInArrow(run, "kind int, code int, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    seen = np.zeros((2, SIDE**3))
    for r in counts.collect():  # two tables at most: SIDE ** 3 numbers each
        seen[r["kind"], r["code"]] = r["n"]
    tables = []
    for own, made in zip(seen, (tally(random_strings()), ordinary_table())):
        tables.append(made + own * (DOCS_WEIGHT * made.sum() / own.sum() if own.sum() else 0))
    return log_ratios(*tables)


def all_spans(text: str, ratios: np.ndarray, bar: float = BAR) -> tuple[list, list]:
    """Base spans, and base and model spans together."""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    added = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        before = bisect_left(starts, e)  # base spans that begin before this one ends
        if before and reach[before - 1] > s:
            continue
        if ratio(m[0], ratios) > bar:
            added.append((s, e, "markov"))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, ratios: np.ndarray, bar: float = BAR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (the base spans as text) and spans (all)."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)  # the same 300,000 numbers for any input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, every = all_spans(t.as_py() or "", held.value, bar)
                n = Counter(kind for _, _, kind in base)
                rows.append((n["assign"], n["access"], n["hex"], written(base), written(every)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def find(docs: DataFrame, **how) -> DataFrame:
    return scan(docs, train(docs), **how)
