"""Periodic runs of words, by Main and Lorentz's divide and conquer.

A run is a stretch of words that repeats with smallest period q at least three times, over MIN_LENGTH words or more, and
that no neighbouring word continues. Words are interned as numbers. A block is halved at its midpoint; every run in it that crosses
the midpoint has a whole period on one side of it, so four Z-functions (of either half, against itself and the block)
tell for each period how far the stretch reaches both ways. Runs that don't cross are found in the halves. A stretch that goes on
beyond its block crosses the midpoint of a larger block, where it is found whole, so it is dropped here. The same stretch is also found at multiples of its
period, and at several midpoints; each interval is kept once, with its smallest period.

Every GRAM words in a row inside a run stand once more in it, a period away (GRAM = 9 holds for 3 periods and
24 words, see `candidates`). So a block is searched only where its GRAM-grams are repeated in the text: in most
texts nowhere. The search takes time n log n and memory n for a text of n words, of which a task holds one.

Defined cases: a null text has no words; a null doc_id has no hash, so its text is not rewritten; rows with equal doc_id are
judged each by itself; equal exponents go to the smallest start, then period; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_LENGTH = 24
MIN_REPEATS = 3
#: In a run of length L >= max(24, 3q), the GRAM words at i recur at i + q or i - q if L >= 2q + GRAM - 1, as 9 ensures.
GRAM = 9
#: A shorter run inside one of period q is shorter than 1.5 q (else both have one period), so below MIN_LENGTH for these q.
DENSE = 16
TEXTS_AT_ONCE = 500

Run = tuple[int, int, int]


def matching(s: np.ndarray, a: int, b: int) -> int:
    """How many words s[a:] and s[b:] have in common at their starts (a < b), compared in growing pieces."""
    k, step, n = 0, 16, len(s)
    while b + k < n:
        differ = s[a + k : min(a + k + step, n - b + a)] != s[b + k : b + k + step]
        first = int(differ.argmax())
        if differ[first]:
            return k + first
        k += len(differ)
        step *= 2
    return n - b


def z_function(s: np.ndarray) -> np.ndarray:
    """z[i]: the length of the common start of s and s[i:]. Only places that hold the first word are visited; elsewhere it is 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in (np.flatnonzero(s[1:] == s[0]) + 1).tolist() if n > 1 else ():
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            k += matching(s, k, i + k)
            left, right = i, i + k
        z[i] = k
    if n:
        z[0] = n
    return np.array(z, np.int64)


def crossing(s: np.ndarray, mid: int) -> list[Run]:
    """start, end, period of stretches of s that cross mid, from the Z-functions of both halves."""
    n, found = len(s), []
    turned = s[::-1]
    wall = np.array([-1], s.dtype)
    for block, at, flip in ((s, mid, False), (turned, n - mid, True)):
        # The first period to the right of the midpoint; for the mirrored block, to the left of it.
        first, rest = block[:at], block[at:]
        if not len(rest):
            continue
        ahead = z_function(rest)
        back = z_function(np.concatenate([first[::-1], wall, block[::-1]]))[at + 1 :]
        p = np.arange(1, len(rest) + 1)
        forth = np.append(ahead[1:], 0)
        # Common end of block[:at] and block[:at + p]: in the mirrored block, at + p is place n - at - p.
        behind = np.append(back, 0)[n - at - p]
        length = forth + behind + p
        good = np.flatnonzero(length >= np.maximum(MIN_LENGTH, MIN_REPEATS * p))
        for i in good.tolist():
            a, b, q = at - int(behind[i]), at + int(p[i]) + int(forth[i]), int(p[i])
            found.append((n - b, n - a, q) if flip else (a, b, q))
    return found


def candidates(s: np.ndarray) -> list[tuple[int, int]]:
    """The stretches where all GRAM-grams are found more than once in s; a run lies in one of them as a whole."""
    n = len(s) - GRAM + 1
    if n < 2:
        return []
    grams = s[:n].astype(np.uint64)
    for i in range(1, GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + s[i : n + i].astype(np.uint64)
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (counts[which] > 1).view(np.int8), [0]])))
    return [(int(a), int(b) + GRAM - 1) for a, b in zip(edges[::2], edges[1::2]) if b - a + GRAM - 1 >= MIN_LENGTH]


def find_runs(s: np.ndarray) -> list[Run]:
    """start, length, period of all runs of the interned words s, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for begin, end in candidates(s):
        todo = [(begin, end, [])]
        while todo:
            lo, hi, dense = todo.pop()
            if hi - lo < MIN_LENGTH or any(a <= lo and hi <= b for a, b in dense):
                continue
            dense = [(a, b) for a, b in dense if a < hi and lo < b]
            mid = (lo + hi) // 2
            for a, b, q in crossing(s[lo:hi], mid - lo):
                a, b = a + lo, b + lo
                # One that goes on beyond the block is found whole in a larger one.
                if (a == lo and a > 0 and s[a - 1] == s[a - 1 + q]) or (b == hi and b < len(s) and s[b] == s[b - q]):
                    continue
                best[a, b] = min(q, best.get((a, b), q))
                if q <= DENSE:
                    dense.append((a, b))
            todo += [(lo, mid, dense), (mid, hi, dense)]
    return sorted((a, b - a, q) for (a, b), q in best.items())


def intern(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the id's hash asks for, if any."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what follows the first period of a run in it."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    drop = np.cumsum(gone)[:-1] > 0
    return [w for w, d in zip(words, drop.tolist()) if not d]


def split(text: str | None) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ as UTF-8: just what bytes.split() takes for white space."""
    return (text or "").encode().split()


def strongest(runs: list[Run]) -> Run | None:
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def judged(text: str | None, doc_id: int | None, planted: bool) -> tuple:
    words = split(text)
    if planted:
        words = rewritten(words, doc_id)
    runs = find_runs(intern(words)) if len(words) >= MIN_LENGTH else []
    top = strongest(runs)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(runs), *best, "".join(f"{a},{n},{q}\n" for a, n, q in runs), b" ".join(collapsed(words, runs))


def detect(docs: DataFrame, planted: bool = False, digests: bool = False) -> DataFrame:
    """doc_id and FOUND: the number of runs, the one with the greatest exponent, all runs as text, the text without repetitions.

    planted: rewrite texts by their ids' hashes first. digests: SHA-256 in hex in place of the last two columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string()]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b, rows = whole.slice(at, TEXTS_AT_ONCE), []
                for doc_id, t in zip(b.column(0), b.column(1)):
                    *numbers, runs, kept = judged(t.as_py(), doc_id.as_py(), planted)
                    if digests:
                        rows.append((*numbers, hashlib.sha256(runs.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                    else:
                        rows.append((*numbers, runs, kept.decode()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {FOUND}")
