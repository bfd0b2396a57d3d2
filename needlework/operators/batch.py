"""Many needles against many haystacks: presence, counts, and sums over the haystacks.

Two ways give the same rows.  ``join`` is a containment join with the needles broadcast: plain SQL, for
a handful.  ``scan`` reads the haystacks once in Arrow batches with one automaton over all needles, so a
text costs its length and its matches, not its length times the needles.  A scan's needles are bounded by
``BLOCK_BYTES``, for an automaton takes some hundred bytes a byte; more needles make further blocks, each
a scan of its own, so neither way broadcasts an unbounded table.  ``auto`` takes ``join`` up to
``JOIN_NEEDLES`` needles of ``JOIN_BYTES`` in all: there it stays inside the JVM.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.functions import search
from needlework.plans.layout import spread

JOIN_NEEDLES = 8
JOIN_BYTES = 1 << 16
#: Bytes of the needles that one scan looks for, and most that are broadcast.
BLOCK_BYTES = 1 << 20
#: Rows that a scan hands over at once.
OUT_ROWS = 1 << 16

_VALUE = itemgetter(1)


def _sized(needles: DataFrame) -> tuple[int, int]:
    n, size = needles.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()
    return n, size


def _strategy(needles: DataFrame, strategy: str) -> str:
    """join or scan; a join of more needles than may be broadcast is a scan too."""
    if strategy == "scan":
        return strategy
    n, size = _sized(needles)
    if strategy == "join":
        return "join" if size <= BLOCK_BYTES else "scan"
    return "join" if n <= JOIN_NEEDLES and size <= JOIN_BYTES else "scan"


def _blocks(needles: DataFrame) -> Iterator[list[str]]:
    """The distinct needles, in blocks of BLOCK_BYTES; a partition at a time passes the driver."""
    block, size = [], 0
    for (needle,) in needles.select("needle").where("needle is not null").distinct().toLocalIterator():
        block.append(needle)
        size += len(needle.encode()) + 8
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _overlaps_itself(w: str) -> bool:
    """Whether two occurrences of w may overlap: some proper prefix is also its end."""
    return any(w.startswith(w[at:]) for at in range(1, len(w)))


class Matcher:
    """One automaton over a block of distinct needles; needles go by their place in the block."""

    def __init__(self, block: list[str]):
        import ahocorasick

        self.block = block
        self.empty = [k for k, w in enumerate(block) if not w]
        self.overlapping = {k for k, w in enumerate(block) if _overlaps_itself(w)}
        self.automaton = ahocorasick.Automaton()
        for k, w in enumerate(block):
            if w:
                self.automaton.add_word(w, k)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _matches(self, text: str):
        return map(_VALUE, self.automaton.iter(text)) if len(self.automaton) else ()

    def present(self, text: str) -> dict[int, int]:
        """1 for each needle that occurs; the empty one does."""
        return dict.fromkeys([*self.empty, *set(self._matches(text))], 1)

    def counts(self, text: str, overlap: bool) -> dict[int, int]:
        """How often each needle occurs that does; matches of one that overlaps itself are counted anew where they may not overlap."""
        found = Counter(self._matches(text))
        if not overlap:
            for k in self.overlapping.intersection(found):
                found[k] = text.count(self.block[k])
        return found


@lru_cache(maxsize=2)
def _matcher(block: tuple[str, ...]) -> Matcher:
    return Matcher(list(block))


def _scans(hays: DataFrame, needles: DataFrame, run, schema: str) -> DataFrame:
    """The union of one scan a block; ``run(matcher, batches)`` makes a scan's rows."""
    spark, out = hays.sparkSession, None
    rows = spread(hays.select(F.col("hay_id").cast("long"), "text").where("text is not null"))
    for block in _blocks(needles):
        sent = spark.sparkContext.broadcast(tuple(block))  # at most BLOCK_BYTES

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from run(_matcher(sent.value), batches)

        found = rows.mapInArrow(scan, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _pairs(hays: DataFrame, needles: DataFrame, counts: bool, overlap: bool = False) -> DataFrame:
    """(hay_id, needle, n) of every needle that occurs in a haystack."""

    def run(matcher: Matcher, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(matcher.block, pa.string())
        ids, places, ns = [], [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), words.take(pa.array(places, pa.int32())), pa.array(ns, pa.int64())]
            ids.clear(), places.clear(), ns.clear()
            return pa.record_batch(columns, names=["hay_id", "needle", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = matcher.counts(text.as_py(), overlap) if counts else matcher.present(text.as_py())
                ids += [i] * len(found)
                places += found.keys()
                ns += found.values()
                if len(ids) >= OUT_ROWS:
                    yield flush()
        if ids:
            yield flush()

    return _scans(hays, needles, run, "hay_id long, needle string, n long")


def has_pairs(hays: DataFrame, needles: DataFrame, strategy: str = "auto") -> DataFrame:
    """(hay_id, needle) of every needle (distinct) that occurs in a haystack (hay_id, text)."""
    if _strategy(needles, strategy) == "scan":
        return _pairs(hays, needles, False).select("hay_id", "needle")
    few = needles.select("needle").distinct()  # at most BLOCK_BYTES, checked above
    return hays.join(F.broadcast(few), F.contains("text", "needle")).select(F.col("hay_id").cast("long"), "needle")


def count_pairs(hays: DataFrame, needles: DataFrame, overlap: bool = False, strategy: str = "auto") -> DataFrame:
    """(hay_id, needle, n) with n > 0: how often each needle occurs."""
    if _strategy(needles, strategy) == "scan":
        return _pairs(hays, needles, True, overlap)
    few = needles.select("needle").where("needle <> ''").distinct()  # at most BLOCK_BYTES, checked above
    met = hays.join(F.broadcast(few), F.contains("text", "needle"))
    return met.select(F.col("hay_id").cast("long"), "needle", search.count("text", F.col("needle"), overlap).alias("n"))


def totals(hays: DataFrame, needles: DataFrame, overlap: bool = False) -> DataFrame:
    """(needle, hays, n): in how many haystacks each needle occurs, and how often; summed inside the scan, a row a needle and task.

    The empty needle is in every haystack, and counted 0 times; needles that occur nowhere have no row.
    """

    def run(matcher: Matcher, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, often, texts = Counter(), Counter(), 0
        for batch in batches:
            for text in batch.column(1):
                found = matcher.counts(text.as_py(), overlap)
                met.update(found.keys())
                often.update(found)
                texts += 1
        met.update(dict.fromkeys(matcher.empty, texts) if texts else {})
        words = pa.array([matcher.block[k] for k in met], pa.string())
        yield pa.record_batch([words, pa.array(met.values(), pa.int64()), pa.array([often[k] for k in met], pa.int64())], names=["needle", "hays", "n"])

    found = _scans(hays, needles, run, "needle string, hays long, n long")
    return found.groupBy("needle").agg(F.sum("hays").alias("hays"), F.sum("n").alias("n"))


def has_bits(hays: DataFrame, needles: list[str]) -> DataFrame:
    """(hay_id, bits): for a stated list of needles, an array of presence in its order, duplicates answered alike."""
    return hays.select("hay_id", F.array(*[search.has("text", w) for w in needles]).alias("bits"))


def count_list(hays: DataFrame, needles: list[str], overlap: bool = False) -> DataFrame:
    """(hay_id, counts): for a stated list of needles, an array of counts in its order."""
    return hays.select("hay_id", F.array(*[search.count("text", w, overlap) for w in needles]).alias("counts"))


def has_semi(hays: DataFrame, needles: DataFrame, strategy: str = "auto") -> DataFrame:
    """The needles that occur in some haystack."""
    if _strategy(needles, strategy) == "scan":
        return totals(hays, needles).select("needle")
    return has_pairs(hays, needles, "join").select("needle").distinct()


def has_anti(hays: DataFrame, needles: DataFrame, strategy: str = "auto") -> DataFrame:
    """The haystacks (hay_id) in which no needle occurs; null texts are among them."""
    hit = has_pairs(hays, needles, strategy).select("hay_id").distinct()
    return hays.select("hay_id").join(hit, "hay_id", "left_anti")
