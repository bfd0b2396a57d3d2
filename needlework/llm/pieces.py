"""Cutting texts where a byte-level tokenizer's pattern always cuts, so that pieces can be looked up.

The pattern attaches a single space to the letters, digits or signs that follow it, and its white-space
branch stops before that space.  No match therefore spans a place where a space meets a non-space, and
the encoding of a text is that of its pieces, joined.  A worker looks pieces up in a table that holds
those met so far; the table is emptied when full, which costs time but changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Characters of text taken together, so that a batch of long documents stays small.
BATCH_CHARS = 4_000_000
#: Characters of the pieces that a table keeps: scripts without spaces make few and long ones.
MOST_CHARS = 16_000_000

_ODD = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")
#: A space before these, or at the end, is no cut; in ASCII texts there are no other white spaces.
_ASCII_ODD = tuple(" " + c for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")


def _even(text: str) -> bool:
    """Whether every space of the text is a cut."""
    if text.isascii():
        return not text.endswith(" ") and not any(c in text for c in _ASCII_ODD)
    return not _ODD.search(text)


def cut(text: str) -> tuple[str, list[str]]:
    """The text before its first cut, and the pieces after each, without the space that begins them."""
    if _even(text):
        head, *rest = text.split(" ")
        return head, rest
    at = [m.start() for m in _CUT.finditer(text)]
    if not at:
        return text, []
    return text[: at[0]], [text[a + 1 : b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


class _Known(dict):
    """Values by piece; a piece not met before stands for itself, and is noted, until it has one."""

    def __init__(self):
        super().__init__()
        self.new: set[str] = set()
        self.missed = 0

    def __missing__(self, piece: str) -> str:
        self.new.add(piece)
        self.missed += 1
        return piece


class Table:
    """Pieces looked up in a table of at most about ``most`` pieces and MOST_CHARS characters; ``encode`` turns a list of strings into their values (no strings)."""

    def __init__(self, encode: Callable[[list[str]], list], most: int):
        self.encode, self.most, self.chars = encode, most, 0
        self.spaced, self.heads = _Known(), _Known()

    def values(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its pieces, in order."""
        if max(len(self.spaced), len(self.heads)) > self.most or self.chars > MOST_CHARS:
            self.spaced.clear()
            self.heads.clear()
            self.chars = 0
        heads, spaced = self.heads, self.spaced
        found = []
        for text in texts:
            head, rest = cut(text)
            before = spaced.missed
            values = list(map(spaced.__getitem__, rest))
            found.append((heads[head] if head else None, values, spaced.missed > before))
        for known, space in ((spaced, " "), (heads, "")):
            new = list(known.new)
            known.new.clear()
            self.chars += sum(map(len, new))
            known.update(zip(new, self.encode([space + p for p in new]), strict=True))
        for head, values, missed in found:
            if missed:
                values = [spaced[v] if type(v) is str else v for v in values]
            if head is not None:
                values.insert(0, heads[head] if type(head) is str else head)
            yield values


def slices(keys: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of about ``BATCH_CHARS`` characters; null texts are empty."""
    a, b, size = [], [], 0
    for i, t in zip(keys, texts, strict=True):
        a.append(i)
        b.append(t or "")
        size += len(t or "") + 1
        if size >= BATCH_CHARS:
            yield a, b
            a, b, size = [], [], 0
    if a:
        yield a, b
