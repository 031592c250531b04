"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted
(rolled) by its place, through multiplication; a text's vector bundles (adds) the vectors of all its n-grams;
a language's prototype bundles the normalised vectors of labelled texts. A text gets the language of the prototype
with the largest cosine.

The letters are those of the text in lower case, with one space for each run of other characters. Prototypes
are learned from a sample of about PER_LANG texts a language, drawn by a hash of doc_id; the fit sees no other
column than text and lang, and a prediction sees the text alone.

Defined cases: a text that is null or has no letter is `und` with score 0; so is any text if nothing could be learned;
training texts with null lang or without letters teach nothing; equal cosines go to the language first by code point; texts
of any length are read whole, by pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import hash_unit

DIM = 1024
GRAM = 3
PER_LANG = 400
SEED = 11
#: a-z have vectors of their own; all other letters share the rest, by code point.
LETTERS = 128
UNKNOWN = "und"
#: Texts whose vectors are held at once.
ROWS_AT_ONCE = 1024
#: n-gram vectors that a worker holds at once, n-grams and texts that are counted at once: they bound its memory.
CACHE = 12_000
GRAMS_AT_ONCE = 400_000
PARTS_AT_ONCE = 128


def letter_vectors(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 2, (LETTERS, dim), np.int8) * 2 - 1).astype(np.int8)


def letter_table() -> np.ndarray:
    """Code point -> letter number, 0 (a space) for what is no letter; folds case."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (LETTERS - 27)
    return table


class Bundler:
    """Text vectors. Sums of +1 and -1 over fewer than 2**24 n-grams are exact, in whatever order they are added."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        self.dim, self.gram = dim, gram
        self.letters, self.table = letter_vectors(dim, seed), letter_table()
        self.vectors = np.empty((0, dim), np.float32)
        self._forget()

    def _forget(self) -> None:
        self.slot, self.used = np.full(LETTERS**self.gram, -1, np.int32), 0

    def read(self, text: str) -> np.ndarray:
        """Letters and single spaces, with one at either end; empty if there is no letter."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([[0], self.table[code], [0]]).astype(np.int32)
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        return x if len(x) > 1 else x[:0]

    def grams(self, x: np.ndarray) -> np.ndarray:
        n = max(1, len(x) - self.gram + 1)
        out = np.zeros(n, np.int32)
        for place in range(min(self.gram, len(x))):
            out += x[place : place + n] * LETTERS**place
        return out

    def bind(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dim), np.int8)
        for place in range(self.gram):
            out *= np.roll(self.letters, place, axis=1)[grams // LETTERS**place % LETTERS]
        return out.astype(np.float32)

    def _sum(self, parts: list[np.ndarray]) -> np.ndarray:
        """A vector for each list of n-grams: counts times n-gram vectors, at most CACHE distinct n-grams at a time."""
        flat = np.concatenate(parts)
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        distinct = np.unique(flat)
        if len(distinct) <= CACHE:
            return self._slice(flat, row, len(parts))
        total = np.zeros((len(parts), self.dim), np.float32)
        group = np.searchsorted(distinct, flat) // CACHE
        for g in range(group.max() + 1):
            own = group == g
            total += self._slice(flat[own], row[own], len(parts))
        return total

    def _slice(self, flat: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        new = np.unique(flat[self.slot[flat] < 0])
        if self.used + len(new) > CACHE:
            self._forget()
            new = np.unique(flat)
        if len(new):
            if not len(self.vectors):
                self.vectors = np.empty((CACHE, self.dim), np.float32)
            self.vectors[self.used : self.used + len(new)] = self.bind(new)
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        slots = self.slot[flat]
        present = np.flatnonzero(np.bincount(slots, minlength=self.used))
        place = np.empty(self.used, np.int64)
        place[present] = np.arange(len(present))
        counts = np.bincount(row * len(present) + place[slots], minlength=n_rows * len(present)).reshape(n_rows, -1)
        out = np.zeros((n_rows, self.dim), np.float32)
        for lo in range(0, len(present), 4096):  # copies of a bounded number of vectors
            own = present[lo : lo + 4096]
            out += counts[:, lo : lo + 4096].astype(np.float32) @ self.vectors[own]
        return out

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of the texts, and which of them have letters."""
        total, known = np.zeros((len(texts), self.dim)), np.zeros(len(texts), bool)
        rows, parts, size = [], [], 0

        def flush() -> None:
            nonlocal size
            if parts:
                np.add.at(total, rows, self._sum(parts))
            rows.clear(), parts.clear()
            size = 0

        for i, text in enumerate(texts):
            x = self.read(text or "")
            if not len(x):
                continue
            known[i] = True
            g = self.grams(x)
            for j in range(0, len(g), GRAMS_AT_ONCE):
                rows.append(i), parts.append(g[j : j + GRAMS_AT_ONCE])
                size += len(parts[-1])
                if size >= GRAMS_AT_ONCE or len(parts) >= PARTS_AT_ONCE:
                    flush()
        flush()
        return total, known


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(lo, ROWS_AT_ONCE)


def sample(labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """About per_lang texts of each lang: those whose hash of doc_id is below per_lang / texts of the lang.

    The counts, one row a lang, are all that is gathered; texts are filtered where they are read.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return known.select("lang", "text").limit(0)
    shares = F.create_map(*[F.lit(x) for lang in sorted(counts) for x in (lang, min(1.0, per_lang / counts[lang]))])
    return known.where(hash_unit("doc_id") < shares[F.col("lang")]).select("lang", "text")


def fit(labelled: DataFrame, per_lang: int = PER_LANG, dim: int = DIM, gram: int = GRAM) -> dict[str, list[float]]:
    """lang -> prototype. The driver gets one vector for each lang of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Bundler(dim, gram), {}
        for b in slices(batches):
            vectors, known = own.bundle(b.column(1).to_pylist())
            for lang, v, has in zip(b.column(0).to_pylist(), vectors, known):
                if has:
                    total[lang] = total.get(lang, 0) + unit(v)
        names = list(total)
        vectors = pa.array([total[k].tolist() for k in names], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), vectors], names=["lang", "v"])

    parts = sample(labelled, per_lang).mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    # Rounded, so that the order in which tasks were added up can't show.
    return {r["lang"]: unit(np.round([p["x"] for p in r["v"]], 6)).tolist() for r in whole.orderBy("lang").collect()}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """doc_id, lang_pred, score."""
    langs = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in langs], np.float64).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bundler(dim, gram)
        for b in slices(batches):
            vectors, known = own.bundle(b.column(1).to_pylist())
            names, scores = [UNKNOWN] * len(known), [0.0] * len(known)
            at = np.flatnonzero(known) if langs else []
            if len(at):
                norm = np.linalg.norm(vectors[at], axis=1)
                cos = np.round(vectors[at] @ matrix.T / np.where(norm > 0, norm, 1)[:, None], 9)
                for i, k, c in zip(at, cos.argmax(1), cos.max(1)):
                    names[i], scores[i] = langs[k], float(min(1.0, max(0.0, c)))
            columns = [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **how) -> DataFrame:
    """Learns from the rows of docs that are not held out and predicts for all: doc_id, held_out, lang_pred, score."""
    prototypes = fit(docs.where(~held_out()), **how)
    return predict(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
