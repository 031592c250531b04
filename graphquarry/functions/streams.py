"""Texts that come in parts: cleaned and cut into chunks while they are read, in memory that doesn't grow with them.

What comes out is what functions/text.py makes of the whole text. A function that needs a text more than once gets a
function that reads it again.
"""

from __future__ import annotations

import codecs
import io
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

#: Bytes read at once, and characters of a part at most where nothing longer was read.
STEP = 1 << 18
CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
BLANKS, LINES = re.compile(r"[ \t]+"), re.compile(r"\n{3,}")
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def decoded(stream) -> Iterator[str]:
    """The text of a stream of UTF-8; other bytes raise UnicodeDecodeError."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    while data := stream.read(STEP):
        yield decoder.decode(data)
    yield decoder.decode(b"", final=True)


def clean_text(parts: Iterable[str]) -> Iterator[str]:
    newlines, begun, blanks = io.IncrementalNewlineDecoder(None, translate=True), False, 0
    for p in chain(parts, [None]):
        t = CONTROL.sub("", newlines.decode(p or "", final=p is None))
        t = t if begun else t.lstrip(" ")
        shown = t.rstrip(" ")
        if shown:
            for at in range(0, blanks, STEP):
                yield " " * min(STEP, blanks - at)
            yield shown
            begun, blanks = True, 0
        blanks += len(t) - len(shown)


def squeezed(parts: Iterable[str], run: re.Pattern, put: str) -> Iterator[str]:
    """Runs replaced by put, which is of the run's characters: one at the end of a part may go on in the next, so its last characters wait."""
    held = ""
    for p in parts:
        t = run.sub(put, held + p)
        end = max(0, len(t) - len(put))
        held = t[end:]
        yield t[:end]
    yield held


def clean_document(parts: Iterable[str]) -> Iterator[str]:
    return squeezed(squeezed(clean_text(parts), BLANKS, " "), LINES, "\n\n")


def last_place(parts: Iterable[str], what: str) -> int:
    """Where `what` begins for the last time, or -1."""
    held, at, last = "", 0, -1
    for p in parts:
        t = held + p
        j = t.rfind(what)
        last = at + j if j >= 0 else last
        held = t[max(0, len(t) - len(what) + 1) :]
        at += len(t) - len(held)
    return last


def uncommented(parts: Iterable[str], last: int) -> Iterator[str]:
    """Without <!-- comments -->. last: the place of the last -->; what begins after it is no comment."""
    held, at, inside = "", 0, False
    for p in chain(parts, [None]):
        t, i = held + (p or ""), 0
        while True:
            j = t.find("-->" if inside else "<!--", i)
            if j < 0 or (not inside and at + j + 4 > last):
                break
            if not inside:
                yield t[i:j]
            i, inside = j + (3 if inside else 4), not inside
        end = max(i, len(t) - (2 if inside else 3)) if p is not None else len(t)
        if not inside:
            yield t[i:end]
        held, at = t[end:], at + end


def clean_markdown(parts: Callable[[], Iterable[str]]) -> Iterator[str]:
    """clean_text, then without comments and runs of empty lines."""
    return squeezed(uncommented(clean_text(parts()), last_place(clean_text(parts()), "-->")), LINES, "\n\n")


def units(parts: Iterable[str], cut: re.Pattern, size: int) -> Iterator[str]:
    """The text between cuts, where it isn't empty. A unit of more than size ends them: it is given as far as it was read."""
    held = ""
    for p in parts:
        t = held + p
        end = len(t.rstrip())
        *whole, last = cut.split(t[:end])
        yield from filter(None, whole)
        if len(last) > size:
            yield last
            return
        held = last + short(t[end:], size)
    yield from filter(None, cut.split(held))


def short(white: str, size: int) -> str:
    """White space that is cut at the same places, or is part of a unit of more than size like the whole."""
    if len(white) <= 4 * size:
        return white
    first, last = white[: size + 1], white[-size - 1 :]
    return first + "\n" * max(0, min(2, white.count("\n")) - (first + last).count("\n")) + last


def packed(given: Iterable[str], size: int, overlap: int, glue: str) -> Iterator[str]:
    """Units joined to chunks of at most size, each beginning with the last units of the one before it, up to overlap."""
    chunk, total, fresh, g = deque(), 0, 0, len(glue)
    for u in given:
        if fresh and total + len(u) + g > size + g * (len(chunk) > fresh):
            yield glue.join(chunk)
            while total > overlap + g:
                total -= len(chunk.popleft()) + g
            fresh = 0
        chunk.append(u)
        total, fresh = total + len(u) + g, fresh + 1
    if fresh:
        yield glue.join(chunk)


def windows(parts: Iterable[str], size: int, step: int) -> Iterator[str]:
    held, i = "", 0
    for p in parts:
        held, i = held[i:] + p, 0
        while i + size <= len(held):
            yield held[i : i + size]
            i += step
    for j in range(i, len(held), step):
        yield held[j : j + size]


def semantic_chunks(parts: Callable[[], Iterable[str]], n: int, size: int = 1000, overlap: int = 200) -> Iterator[str]:
    """The chunks of text.semantic_chunks, of a text of n characters without carriage returns."""
    if n <= size:
        found = iter(["".join(parts())])
    else:
        for cut, glue in ((PARAGRAPH, "\n\n"), (SENTENCE, " ")):
            if all(len(u) <= size for u in units(parts(), cut, size)):
                found = packed(units(parts(), cut, size), size, overlap, glue)
                break
        else:
            found = windows(parts(), size, size - min(overlap, size - 1))
    return (c for c in found if c.strip())
