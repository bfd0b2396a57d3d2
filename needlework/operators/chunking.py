"""Content-defined chunks of haystacks, and what they share.

A chunk ends where a rolling gear hash of the bytes has its low bits clear, not before ``LEAST`` nor
after ``MOST`` bytes.  The hash shifts left by one a byte, so its low 12 bits depend on the last 12
bytes only: candidate ends come from one vectorised pass, and only the choice among them is sequential.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needlework.plans.layout import spread

# fixed values: the seed and steps that make the gear table, the bounds and the mask of a chunk
SEED = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
LEAST, MOST, BITS = 1024, 16384, 12


def gear() -> np.ndarray:
    """256 values, each the mixed sum of the one before and its index; 64-bit, wrapping."""
    wrap, value, out = 2**64 - 1, SEED, []
    for i in range(256):
        z = (value + i + SEED) & wrap
        for shift, factor in ((30, MIX_1), (27, MIX_2)):
            z = (z ^ z >> shift) * factor & wrap
        value = z ^ z >> 31
        out.append(value)
    return np.array(out, np.uint64)


_GEAR = gear()


# fixed values: the shifts and the factor of the table that the search for repeats has for itself
SHIFTS, FACTOR = (12, 25, 27), 0x2545F4914F6CDD1D


def repeats_gear() -> np.ndarray:
    """256 values: a shift-register sequence, each state multiplied on, and its index times the seed added; 64-bit, wrapping."""
    wrap, state, out = 2**64 - 1, SEED, []
    for i in range(256):
        state ^= state >> SHIFTS[0]
        state ^= state << SHIFTS[1] & wrap
        state = (state ^ state >> SHIFTS[2]) * FACTOR & wrap
        out.append(state + i * SEED & wrap)
    return np.array(out, np.uint64)


def cuts(data: bytes, least: int = LEAST, most: int = MOST, table: np.ndarray = _GEAR) -> list[int]:
    """Ends of the chunks of ``data``, the last one included."""
    n = len(data)
    if not n:
        return []
    g = table[np.frombuffer(data, np.uint8)]
    low = np.zeros(n, np.uint64)
    for back in range(min(BITS, n)):  # the hash before position p sums the gears of p-1, p-2, ... shifted
        low[back:] += g[: n - back] << np.uint64(back)
    # an end at position p tests the hash of the bytes before p; chunks are longer than BITS, so earlier ones do not matter
    ends = np.flatnonzero((low & np.uint64((1 << BITS) - 1)) == 0) + 1
    out, begin = [], 0
    while begin < n:
        at = np.searchsorted(ends, begin + least)
        end = int(ends[at]) if at < len(ends) else n
        end = min(end, begin + most, n)
        out.append(end)
        begin = end
    return out


def chunks(hays: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(hay_id, seq, off, chunk): the chunks of every text's bytes, in order; null texts have none."""
    if least < BITS:
        raise ValueError(f"chunks have {BITS} bytes at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ends = cuts(data, least, most)
                starts = [0, *ends[:-1]] if ends else []
                parts = [data[a:b] for a, b in zip(starts, ends, strict=True)]
                yield pa.record_batch(
                    [pa.array([i] * len(ends), pa.int64()), pa.array(range(len(ends)), pa.int32()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())],
                    names=["hay_id", "seq", "off", "chunk"],
                )

    return spread(hays.select(F.col("hay_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "hay_id long, seq int, off long, chunk binary")


def fixed_chunks(hays: DataFrame, size: int) -> DataFrame:
    """(hay_id, seq, off, chunk): whole chunks of ``size`` bytes, one after the other."""
    whole = F.floor(F.octet_length("text") / size).cast("int")
    rows = hays.where(F.octet_length("text") >= size).select("hay_id", F.encode("text", "UTF-8").alias("raw"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("seq"))
    return rows.select("hay_id", "seq", (F.col("seq") * size).cast("long").alias("off"), F.expr(f"substring(raw, seq * {size} + 1, {size})").alias("chunk"))


def twins(parts: DataFrame) -> DataFrame:
    """(chunk, n, hays): chunks that occur twice or more, with their number and that of their haystacks."""
    return parts.groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("hay_id").alias("hays")).where("n > 1")


def dedup_stats(parts: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, raw and resident bytes."""
    size = F.octet_length("chunk")
    per = parts.groupBy("chunk").agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(size * F.col("n")).alias("raw_bytes"), F.sum(size).alias("resident_bytes")
    )


def assemble(parts: DataFrame) -> DataFrame:
    """(hay_id, bytes): contents put together again from their chunks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda s: F.decode(s["chunk"], "ISO-8859-1"))
    return parts.groupBy("hay_id").agg(F.encode(F.array_join(ordered, ""), "ISO-8859-1").alias("bytes"))


def read_chunks(parts: DataFrame, off: int, length: int) -> DataFrame:
    """(hay_id, bytes): a byte range read from the chunks that it touches alone."""
    size = F.octet_length("chunk")
    touched = parts.where((F.col("off") < off + length) & (F.col("off") + size > off))
    first = F.greatest(F.lit(off) - F.col("off"), F.lit(0)).cast("int")
    cut = F.substring("chunk", first + 1, F.least(size, (F.lit(off + length) - F.col("off")).cast("int")) - first)
    return assemble(touched.withColumn("chunk", cut))


def offsets(parts: DataFrame) -> DataFrame:
    """(hay_id, seq, off) recomputed from the chunks' lengths: a running sum a haystack."""
    before = Window.partitionBy("hay_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("hay_id", "seq", F.coalesce(F.sum(F.octet_length("chunk")).over(before), F.lit(0)).cast("long").alias("off"))


def chunk_table(parts: DataFrame) -> DataFrame:
    """(chunk_hay, chunk_seq, chunk, refs): a row a distinct chunk, named by its first place; contents are compared, not hashes."""
    first = F.min(F.struct("hay_id", "seq")).alias("first")
    return parts.groupBy("chunk").agg(first, F.count("*").alias("refs")).select(F.col("first.hay_id").alias("chunk_hay"), F.col("first.seq").alias("chunk_seq"), "chunk", "refs")


def object_table(parts: DataFrame) -> DataFrame:
    """(hay_id, chunks, bytes, digest): each content's number of chunks, length, and a digest of its chunks' digests in order."""
    size = F.octet_length("chunk")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.md5("chunk").alias("own")))), lambda s: s["own"]), "")
    return parts.groupBy("hay_id").agg(F.count("*").alias("chunks"), F.sum(size).cast("long").alias("bytes"), F.md5(listed).alias("digest"))
