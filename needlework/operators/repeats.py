"""Repeated substrings: exact windows in SQL, suffix order, and a budgeted search of single haystacks.

A candidate of length len that occurs count times (without overlap) in a haystack of n characters is
ranked by the size that would be left, ``len + n - count * (len - marker)``: lower is better; then the
longer, then the more frequent, then the smaller substring.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needlework.functions import search
from needlework.operators import chunking
from needlework.plans.layout import spread


@dataclass(frozen=True)
class Options:
    """min_len and max_len of a repeat, the least count, and how many a haystack reports; base fixes the marker."""

    min_len: int = 4
    max_len: int = 256
    min_count: int = 2
    top_k: int = 24
    base: int = 0


def windows(hays: DataFrame, k: int, stride: int) -> DataFrame:
    """(hay_id, pos, sub): windows of k characters at every multiple of stride.

    One regular expression cuts all windows in a pass: each looks ahead at its k characters and takes stride
    of them; a substring a position would walk the text again for each.
    """
    found = F.regexp_extract_all("text", F.lit(f"(?=([\\s\\S]{{{k}}}))[\\s\\S]{{1,{stride}}}"), F.lit(1))
    rows = spread(hays.select("hay_id", "text")).select("hay_id", F.posexplode(found).alias("i", "sub"))
    return rows.select("hay_id", (F.col("i") * stride).cast("long").alias("pos"), "sub")


def corpus_windows(hays: DataFrame, k: int = 16, stride: int = 16, min_count: int = 2) -> DataFrame:
    """(sub, n, hays): windows that occur min_count times or more in the whole corpus."""
    return windows(hays, k, stride).groupBy("sub").agg(F.count("*").alias("n"), F.countDistinct("hay_id").alias("hays")).where(F.col("n") >= min_count)


def hay_windows(hays: DataFrame, k: int = 16, stride: int = 16, min_count: int = 2) -> DataFrame:
    """(hay_id, sub, n): windows that occur min_count times or more in one haystack."""
    return windows(hays, k, stride).groupBy("hay_id", "sub").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def scored(hays: DataFrame, scales: tuple[int, ...] = (16,), options: Options = Options(top_k=8)) -> DataFrame:  # noqa: B008
    """(hay_id, sub, len, n, est_lin, place): the exact mode: windows at each scale, counted and ranked."""
    found = None
    for k in scales:
        own = hay_windows(hays, k, k, options.min_count).select("hay_id", "sub")
        found = own if found is None else found.union(own)
    met = found.join(hays.select("hay_id", "text"), "hay_id").withColumn("n", search.count("text", F.col("sub")))
    met = met.where(F.col("n") >= options.min_count).withColumn("len", F.length("sub"))
    met = met.withColumn("est_lin", search.est_lin(F.col("len"), F.length("text"), F.col("n"), options.base or None))
    order = Window.partitionBy("hay_id").orderBy("est_lin", F.desc("len"), F.desc("n"), "sub")
    ranked = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= options.top_k)
    return ranked.select("hay_id", "sub", F.col("len").cast("long"), "n", "est_lin", F.col("place").cast("long"))


def rare_grams(hays: DataFrame, k: int = 3, stride: int = 8, least: int = 2, most: int = 64) -> DataFrame:
    """(sub, n): grams at every multiple of stride (1: all) with least to most hits in the corpus; runs of one blank are left out."""
    rows = windows(hays, k, stride).where(~F.col("sub").isin(" " * k, "\n" * k, "\0" * k))
    return rows.groupBy("sub").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))


#: Symbols of haystacks whose suffixes are sorted together.
TOGETHER = 1 << 14


def _cut(keys: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of haystacks of about TOGETHER bytes; a longer one is a run by itself."""
    own, held, size = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        if held and size + len(text) > TOGETHER:
            yield own, held
            own, held, size = [], [], 0
        own.append(key)
        held.append(text)
        size += len(text)
    if held:
        yield own, held


def suffix_order(data: np.ndarray, ends: np.ndarray, enough: int = 2**62) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, common prefix with the one before) of the haystacks that end at ``ends`` in ``data``, one after the other.

    Suffixes that share ``enough`` symbols may stay in any order; common prefixes are held there.

    Prefix doubling: suffixes are sorted by their first symbols, packed in a word; those that still share a rank
    are sorted again by the rank of what follows, twice as far each time.  The ranks of every round
    give the common prefixes: from the longest round down, equal ranks mean as many equal symbols.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.unique(data)
    code = np.searchsorted(known, data).astype(np.int64) + 1
    bits = int(len(known)).bit_length()
    wide = max(1, min(8, 62 // bits))
    sizes = np.diff(np.r_[0, ends])
    hay = np.repeat(np.arange(len(ends)), sizes)
    end = np.repeat(ends, sizes)
    at = np.arange(n)
    packed = np.zeros(n, np.int64)
    for k in range(wide):  # beyond a haystack's end symbols are 0
        packed <<= bits
        here = at + k < end
        packed[here] += code[at[here] + k]
    order = np.argsort(packed)
    if len(ends) > 1:
        order = order[np.argsort(hay[order].astype(np.min_scalar_type(len(ends))), kind="stable")]
    fresh = np.r_[True, (packed[order][1:] != packed[order][:-1]) | (hay[order][1:] != hay[order][:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))  # a group's rank is its first place
    levels, step = [(wide, rank.astype(np.int32))], wide
    while True:
        slots = np.flatnonzero(~fresh | ~np.r_[fresh[1:], True])
        if not len(slots) or step >= enough:
            break
        own = order[slots]
        beyond = own + step
        after = np.where(beyond < end[own], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[slots] = own
        begin = np.r_[True, key[1:] != key[:-1]]
        fresh[slots] = begin
        rank[own] = np.maximum.accumulate(np.where(begin, slots, 0))
        step *= 2
        levels.append((step, rank.astype(np.int32)))
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(hay[a] == hay[b])
    a, b = a[alike], b[alike]
    most = np.minimum(end[a] - a, end[b] - b)
    run = np.zeros(len(a), np.int64)
    for width, ranks in reversed(levels):
        live = np.flatnonzero(run + width <= most)
        x, y = a[live] + run[live], b[live] + run[live]
        run[live[ranks[x] == ranks[y]]] += width
    live = np.arange(len(a))
    for _ in range(wide):
        live = live[run[live] < most[live]]
        live = live[code[a[live] + run[live]] == code[b[live] + run[live]]]
        run[live] += 1
    common[alike + 1] = np.minimum(run, enough)
    return order, common


def longest(hays: DataFrame, min_len: int = 4) -> DataFrame:
    """(hay_id, len): the length of the longest substring that occurs twice in each haystack, 0 below min_len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-32-le", "surrogatepass") for t in batch.column(1)]
            for keys, some in _cut(batch.column(0).to_pylist(), texts):
                ends = np.cumsum([len(t) // 4 for t in some])
                common = suffix_order(np.frombuffer(b"".join(some), np.uint32), ends)[1]
                out = np.zeros(len(some), np.int64)
                full = np.flatnonzero(np.diff(np.r_[0, ends]))
                if len(full):
                    out[full] = np.maximum.reduceat(common, np.r_[0, ends][full])
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(np.where(out >= min_len, out, 0))], names=["hay_id", "len"])

    return spread(hays.select(F.col("hay_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "hay_id long, len long")


def lcp_intervals(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, length, parent length) of the LCP intervals of length ``least`` or more: the suffixes at first..first+size-1 share length characters."""
    held = np.where(common >= least, common, 0)
    held[:1] = 0
    near = np.flatnonzero((held > 0) | np.r_[False, held[:-1] > 0])  # and the places that close them
    first, size, length, parent = [], [], [], []
    open_at, open_len = [], [0]
    for at, now in zip([*near.tolist(), len(held)], [*held[near].tolist(), 0], strict=True):
        begin = at - 1
        while open_len[-1] > now:
            most, begin = open_len.pop(), open_at.pop()
            first.append(begin)
            size.append(at - begin)
            length.append(most)
            parent.append(max(now, open_len[-1]))
        if open_len[-1] < now:
            open_at.append(begin)
            open_len.append(now)
    return tuple(np.array(x, np.int64) for x in (first, size, length, parent))


def find_repeats(data: bytes, options: Options) -> list[tuple[int, int, int, int, bytes]]:
    """(off, len, count, est_lin, sub) of one haystack's best repeats, by suffix order over its bytes."""
    return find_all_repeats([data], options)[0]


def find_all_repeats(texts: list[bytes], options: Options) -> list[list[tuple[int, int, int, int, bytes]]]:
    """The same of several haystacks, whose suffixes are sorted together.

    Every LCP interval stands for the substrings between its parent's length and its own, which occur at the
    same places.  Its candidates are the longest that max_len and half the haystack allow, the shortest, and
    those between at which more copies begin to overlap or the marker grows.  Candidates are taken in
    the order of the best est_lin their places allow, and counted exactly until no other can be among the top_k.
    The last of several places goes to the longest repeat if est_lin leaves it out.
    """
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    order, common = suffix_order(np.frombuffer(b"".join(texts), np.uint8), ends, options.max_len)
    first, size, length, parent = lcp_intervals(common, max(1, options.min_len)) if len(order) else [np.zeros(0, np.int64)] * 4
    whose = np.searchsorted(ends, first, side="right")  # suffixes of a haystack are as many as its bytes, in the same places
    n = np.diff(np.r_[0, ends])[whose]
    length = np.minimum(length, np.minimum(options.max_len, n // 2))
    least = np.maximum(parent + 1, max(1, options.min_len))
    held = (length >= least) & (size >= options.min_count) & (n >= 2 * options.min_len)
    whose, first, size, length, least, n = (x[held] for x in (whose, first, size, length, least, n))

    def saved(fit: np.ndarray) -> np.ndarray:
        """The most that copies of each length save if all places count."""
        marker = np.full(len(fit), options.base) if options.base else 4 + 2 * (fit >= 10) + (fit >= 100)
        return np.where(fit > marker, size, options.min_count) * (fit - marker) - fit

    # at a given marker more saves more, up to what the haystack holds without overlap
    steps = [np.clip(x, least, length) for x in (9, 99)]
    whole = n - options.min_count * (options.base or 4) - least
    bound = np.clip(n - np.minimum(np.max([saved(fit) for fit in (length, *steps)], axis=0), whole), -(2**31 - 1), 2**31 - 1)
    starts = np.searchsorted(whose, np.arange(len(texts) + 1)) if (np.diff(whose) >= 0).all() else None
    out = []
    for k, data in enumerate(texts):
        own = np.arange(starts[k], starts[k + 1]) if starts is not None else np.flatnonzero(whose == k)
        base = int(ends[k] - len(data))
        out.append(_best(data, base, order, first[own], size[own], length[own], least[own], bound[own], options) if len(own) and options.top_k > 0 else [])
    return out


def _best(data, base, order, first, size, length, least, bound, options: Options) -> list[tuple[int, int, int, int, bytes]]:
    n = len(data)

    def estimate(sub_len, count):
        marker = options.base or 4 + 2 * (sub_len >= 10) + (sub_len >= 100)
        return max(-(2**31 - 1), min(2**31 - 1, sub_len + n - count * (sub_len - marker)))

    longest = None
    for at in np.argsort(-length, kind="stable").tolist() if options.top_k > 1 else []:
        places, fit = order[first[at] : first[at] + size[at]] - base, int(length[at])
        begin = int(places.min())
        if int(places.max()) - begin < fit * (options.min_count - 1):
            continue
        sub = data[begin : begin + fit]
        count = data.count(sub)
        if count >= options.min_count:
            longest = (begin, fit, count, estimate(fit, count), sub)
            break
    rank = lambda r: (r[3], -r[1], -r[2], r[4])
    best: list[tuple] = []  # (rank, row), sorted
    seen: set[bytes] = set()
    for at in np.argsort(bound, kind="stable").tolist():
        if len(best) == options.top_k and bound[at] > best[-1][1][3]:
            break
        places = order[first[at] : first[at] + size[at]] - base
        places.sort()
        gaps = places[1:] - places[:-1]
        gap, low, high = int(gaps.min()), int(least[at]), int(length[at])
        fits = {high, low} | {f for f in (9, 99) if low < f < high}
        if gap < high:
            fits.update(f for f in np.unique(gaps[gaps < high]).tolist() if f >= low)
        begin = int(places[0])
        for fit in fits:
            sub = data[begin : begin + fit]
            if sub in seen:
                continue
            count = data.count(sub) if gap < fit else len(places)
            if count >= options.min_count:
                seen.add(sub)
                row = (begin, fit, count, estimate(fit, count), sub)
                insort(best, (rank(row), row))
                del best[options.top_k :]
    found = [row for _, row in best]
    if longest and all(longest[1] > r[1] for r in found):
        found = sorted([*found[: options.top_k - 1], longest], key=rank)
    return found


SCHEMA = "hay_id long, off long, len int, n long, est_lin long, sub binary"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ["hay_id", "off", "len", "n", "est_lin", "sub"]


def _as_bytes(column: pa.Array) -> list[bytes]:
    """The values as bytes; null is empty."""
    return [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _by_text(hays: DataFrame, find) -> DataFrame:
    """Rows of SCHEMA that ``find(texts)`` gives for each haystack's bytes; ``text`` may be a string or binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, some in _cut(batch.column(0).to_pylist(), _as_bytes(batch.column(1))):
                rows = [(i, *r) for i, found in zip(keys, find(some), strict=True) for r in found]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    return spread(hays.where("text is not null").select(F.col("hay_id").cast("long"), "text")).mapInArrow(run, SCHEMA)


def repeats(hays: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(hay_id, off, len, n, est_lin, sub): the best repeats of each haystack, a string or binary; no shuffle."""
    return _by_text(hays, lambda texts: find_all_repeats(texts, options))


def _shared(data: str, a: int, b: int) -> int:
    """How many characters from a and from b on are equal."""
    step, run, n = 64, 0, len(data) - b
    while run < n and data[a + run : a + run + step] == data[b + run : b + run + step]:
        run += step
    run = min(run, n)
    while run < n and data[a + run] == data[b + run]:
        run += 1
    return run


def extend_pair(data: str, a: int, b: int, seed: int, max_len: int, backwards: str | None = None) -> tuple[int, int]:
    """(off, len): two equal windows at a < b, of text or of bytes, grown to the left and to the right, held at max_len from the left end."""
    back = data[::-1] if backwards is None else backwards
    left = _shared(back, len(data) - b, len(data) - a)
    right = seed + _shared(data, a + seed, b + seed)
    return a - left, min(max_len, left + right)


def _ranked(data, subs, options: Options) -> list[tuple]:
    """(off, len, count, est_lin, sub) of the distinct substrings that occur often enough, the best first."""
    rows = []
    for sub in dict.fromkeys(subs):
        length, count = len(sub), data.count(sub)
        if count >= options.min_count and length >= options.min_len:
            marker = options.base or 4 + 2 * (length >= 10) + (length >= 100)
            rows.append((data.find(sub), length, count, max(-(2**31 - 1), min(2**31 - 1, length + len(data) - count * (length - marker))), sub))
    return sorted(rows, key=lambda r: (r[3], -r[1], -r[2], r[4]))[: options.top_k]


def _grown(data, windows: Iterator[tuple], options: Options):
    """What the first two of every group of equal windows (content, place) grow to, and a short prefix of each."""
    first: dict = {}
    pairs: dict = {}
    for window, at in windows:
        begin = first.setdefault(window, at)
        if begin != at:
            pairs.setdefault(window, (begin, at))
    back, short = data[::-1], min(8, max(5, options.min_len))
    for window, (a, b) in pairs.items():
        off, length = extend_pair(data, a, b, len(window), options.max_len, back)
        yield data[off : off + length]
        if short < length:
            yield data[off : off + short]


def harvest(data: str, k: int, stride: int, options: Options) -> list[tuple[int, int, int, int, str]]:
    """(off, len, count, est_lin, sub): windows that repeat, extended beyond their grid; counted and ranked."""
    return _ranked(data, _grown(data, ((data[at : at + k], at) for at in range(0, len(data) - k + 1, stride)), options), options)


def short_seeds(data: str, options: Options) -> list[tuple[int, int, int, int, str]]:
    """(off, len, count, est_lin, sub): a gram of min_len (8 at most) at every eighth of its steps, met again and extended; ranked."""
    gram, back, subs = min(8, options.min_len), data[::-1], []
    for at in range(0, len(data) - gram + 1, 8 * gram):
        again = data.find(data[at : at + gram], at + 1)
        if again >= 0:
            off, length = extend_pair(data, at, again, gram, options.max_len, back)
            subs.append(data[off : off + length])
    return _ranked(data, subs, options)


_REPEATS_GEAR = chunking.repeats_gear()


def twin_chunks(data: bytes, options: Options, fixed: tuple[int, ...] = (4096, 1024)) -> list[tuple[int, int, int, int, bytes]]:
    """(off, len, count, est_lin, sub): content-defined chunks, and whole chunks of the fixed sizes, that occur twice, extended; ranked."""
    ends = chunking.cuts(data, table=_REPEATS_GEAR)
    parts = [(data[a:b], a) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    subs = list(_grown(data, iter(parts), options))
    for size in fixed:
        subs += _grown(data, ((data[at : at + size], at) for at in range(0, len(data) - size + 1, size)), options)
    return _ranked(data, subs, options)


def twins(hays: DataFrame, options: Options = Options(), fixed: tuple[int, ...] = (4096, 1024)) -> DataFrame:  # noqa: B008
    """(hay_id, off, len, n, est_lin, sub): the repeats that twin chunks of each haystack, a string or binary, grow to."""
    return _by_text(hays, lambda texts: [twin_chunks(t, options, fixed) for t in texts])


def _by_characters(hays: DataFrame, find) -> DataFrame:
    """(hay_id, off, len, n, est_lin, sub) that ``find`` gives for each text, in characters (of ``latin``: bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(i, *r) for r in find(text.as_py())]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*_KINDS[:5], pa.string()), strict=True)], names=_NAMES)

    rows = hays.where("text is not null").select(F.col("hay_id").cast("long"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(run, SCHEMA.replace("binary", "string"))


def extended(hays: DataFrame, k: int = 16, stride: int = 16, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(hay_id, off, len, n, est_lin, sub): windows that repeat in a haystack, extended beyond their grid and ranked."""
    return _by_characters(hays, lambda text: harvest(text, k, stride, options))


def seeded(hays: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(hay_id, off, len, n, est_lin, sub): the repeats that short seeds find."""
    return _by_characters(hays, lambda text: short_seeds(text, options))
