"""Byte profiles of haystacks: presence, histogram, entropy, label, block grams, and filters made of them.

``build`` makes a profile of every haystack in one pass over its bytes, a row each, to be kept and joined.
Texts are judged as UTF-8 bytes; a binary ``text`` as it is.  The histogram covers the first ``SAMPLE``
bytes, presence all of them.  The budget says how much a profile holds: 0 presence, 1 histogram, entropy
and label too, 2 also the grams of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.functions import search
from needlework.plans.layout import spread

SAMPLE = 131_072
BLOCK = 8192
#: Haystacks from so many bytes on have block grams.
GRAMS_FROM = 4096
#: Entropy (bits a byte) up to which a haystack is labelled high, mixed; beyond, low.
HIGH, MIXED = 3.5, 5.5

SCHEMA = "hay_id long, n long, presence array<int>, hist array<long>, entropy double, grams array<struct<block: int, grams: array<int>>>"
_GRAMS = pa.list_(pa.struct([("block", pa.int32()), ("grams", pa.list_(pa.int32()))]))


def _entropy(hist: np.ndarray) -> float:
    """Bits a byte; 0 of nothing."""
    own = hist[hist > 0]
    n = int(own.sum())
    return abs(float(np.log2(n) - (own * np.log2(own)).sum() / n)) if n else 0.0


def _block_grams(data: np.ndarray, size: int) -> list[dict]:
    """The distinct grams of three bytes that begin in each block; those at a block's end reach into the next."""
    wide = data.astype(np.int32)
    grams = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    return [{"block": k, "grams": np.unique(grams[at : at + size]).tolist()} for k, at in enumerate(range(0, len(data), size))]


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value if isinstance(value, bytes) else value.encode("utf-8", "surrogatepass"), np.uint8)


def build(hays: DataFrame, budget: int = 1) -> DataFrame:
    """(hay_id, n, presence, hist, entropy, grams, label) of every haystack; null texts have nulls and the label mixed.

    presence lists the byte values, hist has 256 counts, grams the trigrams (as numbers) of each block of BLOCK
    bytes where the haystack has GRAMS_FROM bytes.  What the budget leaves out is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, presence, hist, entropy, grams = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                data = None if text is None else _bytes(text)
                n.append(None if data is None else len(data))
                counts = None if data is None else np.bincount(data[:SAMPLE], minlength=256)
                presence.append(None if data is None else np.flatnonzero(np.bincount(data, minlength=256)).tolist())
                hist.append(None if data is None or budget < 1 else counts.tolist())
                entropy.append(None if data is None or budget < 1 else _entropy(counts))
                grams.append(None if data is None or budget < 2 or len(data) < GRAMS_FROM else _block_grams(data, BLOCK))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.float64(), _GRAMS)
            columns = [pa.array(c, k) for c, k in zip((n, presence, hist, entropy, grams), kinds, strict=True)]
            yield pa.record_batch([batch.column(0), *columns], names=["hay_id", "n", "presence", "hist", "entropy", "grams"])

    found = spread(hays.select(F.col("hay_id").cast("long"), "text")).mapInArrow(run, SCHEMA)
    return found.withColumn("label", label_of(F.col("entropy"), budget))


def presence(hays: DataFrame) -> DataFrame:
    """(hay_id, bytes): the distinct bytes of each haystack in hexadecimal, sorted; a projection, no shuffle."""
    return build(hays, 0).select("hay_id", F.transform("presence", lambda b: F.lpad(F.hex(b), 2, "0")).alias("bytes"))


def histogram(hays: DataFrame) -> DataFrame:
    """(hay_id, byte, n) over the first SAMPLE bytes."""
    rows = build(hays).select("hay_id", F.posexplode("hist").alias("byte", "n")).where("n > 0")
    return rows.select("hay_id", F.lpad(F.hex("byte"), 2, "0").alias("byte"), "n")


def entropy(hays: DataFrame) -> DataFrame:
    """(hay_id, n, entropy): bits a byte over the first SAMPLE bytes, to six places; 0 for an empty haystack."""
    return build(hays).select("hay_id", F.when(F.col("n") > SAMPLE, F.lit(SAMPLE).cast("long")).otherwise(F.col("n")).alias("n"), F.abs(F.round("entropy", 6)).alias("entropy"))


def label_of(value: Column, budget: int = 1) -> Column:
    """high, mixed or low redundancy; without a budget mixed."""
    if budget < 1:
        return F.lit("mixed")
    return F.when(value <= HIGH, "high").when(value <= MIXED, "mixed").when(value.isNotNull(), "low").otherwise("mixed")


def label(hays: DataFrame, budget: int = 1) -> DataFrame:
    """(hay_id, label) by the entropy itself, not rounded: an empty haystack has entropy 0 and is high."""
    return build(hays, budget).select("hay_id", "label")


def may_contain(hays: DataFrame, needle: str) -> DataFrame:
    """(hay_id, may): whether all bytes of the needle occur; false only where the needle is absent."""
    return hays.select("hay_id", _may(needle).alias("may"))


def _may(needle: str) -> Column:
    found, raw = F.lit(True), F.encode("text", "UTF-8")
    for b in sorted(set(needle.encode())):  # one native search a distinct byte
        found = found & (F.contains("text", F.lit(chr(b))) if b < 128 else F.contains(raw, F.lit(bytes([b]))))
    return found


def may_contain_profiled(profiles: DataFrame, needle: str) -> DataFrame:
    """(hay_id, may) from profiles alone: all bytes present, and where there are block grams all the needle's grams, in whatever blocks."""
    data = needle.encode()
    may = F.forall(F.array(*map(F.lit, sorted(set(data)))), lambda b: F.array_contains("presence", b)) if data else F.lit(True)
    grams = _grams_of(data)
    if grams:
        every = F.flatten(F.transform("grams", lambda g: g["grams"]))
        may = may & F.coalesce(F.size(F.array_except(F.array(*map(F.lit, grams)), every)) == 0, F.lit(True))
    return profiles.select("hay_id", may.alias("may"))


def _grams_of(data: bytes) -> list[int]:
    return sorted({data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)})


def profiled_blocks(profiles: DataFrame, needle: str, cap: int = 1 << 20) -> DataFrame:
    """(hay_id, blocks): from profiles of budget 2, the blocks in which the needle may begin, ascending.

    A block survives if it holds the needle's first gram, and it and the next all of them, so needles across a border are met.
    Null where that says too little: needles under three bytes or over a block, haystacks without block
    grams, more than ``cap`` survivors, or more than half of the blocks and one.
    """
    data = needle.encode()
    grams = _grams_of(data)
    if not grams or len(data) > BLOCK:
        return profiles.select("hay_id", F.lit(None).cast("array<int>").alias("blocks"))
    wanted, first = F.array(*map(F.lit, grams)), data[0] << 16 | data[1] << 8 | data[2]
    count = F.size("grams")

    def holds(g: Column, k: Column) -> Column:
        after = F.when(k + 1 < count, F.element_at("grams", k + 2)["grams"]).otherwise(F.expr("cast(array() as array<int>)"))
        rest = F.array_except(F.array_except(wanted, g["grams"]), after)
        return F.when(F.array_contains(g["grams"], first) & (F.size(rest) == 0), g["block"])

    found = F.filter(F.transform("grams", holds), lambda b: b.isNotNull())
    few = (F.size(found) <= cap) & (F.size(found) <= F.floor(count / 2) + 1)
    return profiles.select("hay_id", F.when(F.col("grams").isNotNull() & few, found).alias("blocks"))


def blocks(hays: DataFrame, size: int = BLOCK, overlap: int = 0) -> DataFrame:
    """(hay_id, block, bytes): each haystack in blocks of ``size`` bytes, with ``overlap`` of the next."""
    raw = F.encode("text", "UTF-8")
    last = F.floor((F.greatest(F.octet_length("text"), F.lit(1)) - 1) / size).cast("int")
    numbered = hays.where("text is not null").select("hay_id", raw.alias("raw"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return numbered.select("hay_id", "block", F.expr(f"substring(raw, block * {size} + 1, {size + overlap})").alias("bytes"))


def block_labels(hays: DataFrame, size: int = BLOCK, sample: int = 4096) -> DataFrame:
    """(hay_id, block, label) by the entropy of each block's first ``sample`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, found = [], [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _bytes(value.as_py())
                for k, at in enumerate(range(0, max(1, len(data)), size)):
                    ids.append(i)
                    places.append(k)
                    found.append(_entropy(np.bincount(data[at : at + sample], minlength=256)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(found, pa.float64())], names=["hay_id", "block", "entropy"])

    rows = hays.where("text is not null").select(F.col("hay_id").cast("long"), "text").mapInArrow(run, "hay_id long, block int, entropy double")
    return rows.select("hay_id", "block", label_of(F.col("entropy")).alias("label"))


def candidate_blocks(hays: DataFrame, needle: str, size: int = BLOCK) -> DataFrame:
    """(hay_id, block): blocks in which the needle begins; blocks overlap, so a needle across a border counts."""
    wide = max(0, len(needle.encode()) - 1)
    return blocks(hays, size, wide).where(F.contains("bytes", F.lit(needle.encode()))).select("hay_id", "block")


def find_profiled(hays: DataFrame, needle: str, overlap: bool = False) -> DataFrame:
    """(hay_id, off, n): find and count where the needle's bytes all occur, -1 and 0 elsewhere; the answers are those without a profile."""
    rows = hays.select("hay_id", "text", _may(needle).alias("may"))
    off = F.when(F.col("may"), search.find("text", needle)).when(F.col("text").isNotNull(), F.lit(-1))
    n = F.when(F.col("may"), search.count("text", needle, overlap)).when(F.col("text").isNotNull(), F.lit(0))
    return rows.select("hay_id", off.cast("long").alias("off"), n.cast("long").alias("n"))
