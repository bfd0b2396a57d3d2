"""Exact substring search as column expressions: find, count, find all.

Every function takes a haystack column and a needle (a string or a column) and returns a column.
Offsets count characters, or bytes in the ``*_bytes`` forms; -1 means absent.  Null in, null out.

The empty needle follows the fixed contract: found at 0, counted 0 times, present, listed nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str, literal: bool = False) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if literal else F.col(x)


def find(hay: Column | str, needle: Column | str) -> Column:
    """Offset of the leftmost occurrence in characters, or -1."""
    return (F.instr(_col(hay), _col(needle, True)) - 1).cast("long")


def find_bytes(hay: Column | str, needle: Column | str) -> Column:
    """Offset of the leftmost occurrence in UTF-8 bytes, or -1."""
    h, at = _col(hay), F.instr(_col(hay), _col(needle, True))
    return F.when(at == 0, F.lit(-1)).when(at.isNotNull(), F.octet_length(F.substring(h, F.lit(1), at - 1))).cast("long")


def latin(binary: Column | str) -> Column:
    """A string with one character a byte: every string function is then exact over bytes."""
    return F.decode(_col(binary), "ISO-8859-1")


def unlatin(text: Column | str) -> Column:
    """The bytes behind ``latin``."""
    return F.encode(_col(text), "ISO-8859-1")


def has(hay: Column | str, needle: Column | str) -> Column:
    """Whether the needle occurs; the empty needle does."""
    return F.contains(_col(hay), _col(needle, True))


def count(hay: Column | str, needle: Column | str, overlap: bool = False) -> Column:
    """How often the needle occurs: greedy from the left, or at every start."""
    h, n = _col(hay), _col(needle, True)
    if overlap:
        starts = F.regexp_count(h, F.concat(F.lit("(?="), quoted(n), F.lit(")")))
        return F.when(n == "", F.lit(0)).when(n.isNotNull(), starts).cast("long")
    shrunk = F.length(F.replace(h, n, F.lit("")))
    return F.when(n == "", F.lit(0)).when(n.isNotNull(), F.floor((F.length(h) - shrunk) / F.greatest(F.length(n), F.lit(1)))).cast("long")


def quoted(needle: Column) -> Column:
    """The needle as a regular expression that matches it alone."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def find_all(hay: Column | str, needle: Column | str, overlap: bool = False, cap: int | None = None) -> Column:
    """Ascending offsets of the occurrences, at most ``cap``; none for the empty needle.

    The text is split by the quoted needle; lengths of the parts add up to the offsets.  Overlapping
    starts are split at empty places before which nothing is taken: a lookahead.  The list grows by
    copying: where a text may hold very many, use ``operators.listing.find_all_rows``.
    """
    h, n = _col(hay), _col(needle, True)
    wide = F.lit(0) if overlap else F.length(n)
    # a zero-width split drops the empty part before a match at the start, so one character leads
    pattern = F.concat(F.lit("(?="), quoted(n), F.lit(")")) if overlap else quoted(n)
    text = F.concat(F.lit(_LEAD), h) if overlap else h
    parts = F.split(text, pattern, -1)
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p))
    start = F.lit(-1 if overlap else 0)
    state = F.struct(start.cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("found"))

    def step(acc: Column, length: Column) -> Column:
        here = acc["at"] + length
        return F.struct((here + wide).cast("long").alias("at"), F.concat(acc["found"], F.array(here.cast("long"))).alias("found"))

    found = F.aggregate(lengths, state, step, lambda acc: acc["found"])
    found = F.when((n == "") | (F.length(n) > F.length(h)), F.expr("cast(array() as array<bigint>)")).when(n.isNotNull() & h.isNotNull(), found)
    return found if cap is None else F.slice(found, 1, cap)


#: Leads the text in overlapping searches; a match at the very start of a text is never split off.
_LEAD = "\ue000"


def content_hash(value: Column | str) -> Column:
    """A 64-bit hash of a text or of bytes.  Equal hashes are a hint: compare the contents before acting on it."""
    return F.xxhash64(_col(value))


def should_use(n: Column | str, kind: str) -> Column:
    """Advice by length of haystack: search and repeats pay from 64 on; batches always."""
    return (F.lit(True) if kind not in ("find", "repeats") else _col(n) >= 64).cast("int")


def est_lin(length: Column, n: Column, count_: Column, base: int | None = None) -> Column:
    """Estimated size once every occurrence becomes a marker; lower is better; held in 32 bits."""
    marker = F.lit(base) if base else 4 + F.when(length >= 10, 2).otherwise(0) + F.when(length >= 100, 1).otherwise(0)
    value = length.cast("long") + n.cast("long") - count_.cast("long") * (length - marker).cast("long")
    return F.greatest(F.lit(-(2**31 - 1)), F.least(F.lit(2**31 - 1), value)).cast("long")
