"""Token-id files with a minimal perfect hash index.

The file is a Parquet folder of shards, so any store that Spark writes can hold it and task retries
commit once.  A shard is a row:

    part, shard      its place: shards in (part, shard) order hold the documents in ascending key order
    least, most      the first and last of its keys (a null key is the least int64)
    local_start      ids before it in its part
    n_docs, n_tokens
    width            2 or 4: bytes of an id
    payload          the raw ids of its documents, little-endian, one after the other
    keys             per slot, the document's key (int64; a null key is the least int64, flagged)
    seeds            the hash index: displacement seeds of its buckets (uint32)
    offsets          per slot, where the document begins in the payload, counted in ids (uint64)
    lengths          per slot, the number of its ids (uint64)
    prints           per slot, the stored fingerprint of the key (uint32)

A key's slot is ``hash(key, seed of its bucket) mod n_docs``; seeds were sought so that every key has
a slot of its own and none is left over.  A lookup goes to the shards whose range of keys holds the key, by
the reader's own statistics; there it reads one seed, one slot, compares the fingerprint, then the key
itself, and slices the payload: constant time.  A fingerprint that differs means an absent key.  Payloads
are read where a key was found, and nowhere else.

Keys that repeat are told apart by their number of occurrence.  Order of equal keys: by ids.
Defined results: null text is empty (only the end id); a very long text is encoded whole and may be a shard by
itself; a null key comes first; an empty table gives an empty file; other columns are ignored.  The strings of
special tokens in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needlework.llm.common import gc_paused, only
from needlework.llm.pieces import Table, slices
from needlework.plans.layout import spread
from needlework.plans.staging import new_path

CACHE_PIECES = 1_500_000
#: Pieces that are encoded as one text: the pattern makes a match of every line feed between them.
LINES = 2_000
_LINED = re.compile(r" ?\S+(?:\n\S+)*").fullmatch
#: A shard is closed when it holds this many ids or documents; a longer document is a shard by itself.
SHARD_TOKENS = 1 << 20
#: Bytes of text that a part takes, until there are MOST_PARTS of them.
PART_BYTES, MOST_PARTS = 24 << 20, 20_000
SHARD_DOCS = 1 << 12
BUCKET = 2
TRIALS = 32
NULL_KEY = -(2**63)
#: Null keys are numbered from here, to differ from the least key itself.
NULLS = 2**32

SHARD_SCHEMA = (
    "part int, shard int, least long, most long, local_start long, n_docs int, n_tokens long, width int, payload binary, "
    "keys binary, null_key boolean, seeds binary, offsets binary, lengths binary, prints binary"
)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift and multiply rounds), vectorised; wraps."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hash(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + occurrence.astype(np.uint64))


def _slot(h: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h + np.asarray(seed, np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(n)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each key) of a minimal perfect hash over distinct hashes ``h``.

    Buckets are placed from the fullest to the emptiest, each with the first seed that sends its
    keys to free slots; single keys at the end may need many trials, sought a block of seeds at a time.
    """
    n = len(h)
    n_buckets = max(1, (n + BUCKET - 1) // BUCKET)
    bucket = (h % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    first = _slot(h[order][:, None], np.arange(TRIALS, dtype=np.uint64)[None, :], n)  # most buckets need no more
    taken = np.zeros(n, bool)
    seeds, slots = np.zeros(n_buckets, np.uint32), np.zeros(n, np.int64)
    for b in np.argsort(-np.diff(bounds), kind="stable"):
        rows = order[bounds[b] : bounds[b + 1]]
        if not len(rows):
            break
        at, start = first[bounds[b] : bounds[b + 1]].T, 0
        while True:
            hit = next((k for k in np.flatnonzero(~taken[at].any(axis=1)).tolist() if len(set(at[k].tolist())) == len(rows)), None)
            if hit is not None:
                seeds[b], slots[rows] = start + hit, at[hit]
                taken[at[hit]] = True
                break
            start += len(at)
            tried = np.arange(start, start + min(4096, 2 * len(at)), dtype=np.uint64)
            at = _slot(h[rows][None, :], tried[:, None], n)
    return seeds, slots


def pack(docs: list[tuple[int | None, bytes]], width: int) -> dict:
    """A shard's columns from its documents (key, raw ids) in order."""
    kind = np.dtype("<u2" if width == 2 else "<u4")
    keys = np.array([NULL_KEY if k is None else k for k, _ in docs], np.int64)
    lengths = np.array([len(raw) // width for _, raw in docs], np.uint64)
    starts = np.cumsum(lengths) - lengths
    h = _hash(keys, _occurrences(keys, [k is None for k, _ in docs]))
    seeds, slots = build_index(h)
    by_slot = np.empty(len(keys), np.int64)
    by_slot[slots] = np.arange(len(keys))
    return {
        "least": int(keys[0]), "most": int(keys[-1]), "n_docs": len(docs), "n_tokens": int(lengths.sum()), "width": kind.itemsize, "payload": b"".join(raw for _, raw in docs),
        "keys": keys[by_slot].astype("<i8").tobytes(), "null_key": any(k is None for k, _ in docs), "seeds": seeds.astype("<u4").tobytes(),
        "offsets": starts[by_slot].astype("<u8").tobytes(), "lengths": lengths[by_slot].astype("<u8").tobytes(),
        "prints": (h[by_slot] >> np.uint64(32)).astype("<u4").tobytes(),
    }


def _occurrences(keys: np.ndarray, nulls: list[bool]) -> np.ndarray:
    """0, 1, 2 ... among equal neighbours; nulls count from NULLS to differ from the least key itself."""
    runs = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    isnull = np.array(nulls, bool)
    if len(keys):
        runs |= np.r_[True, isnull[1:] != isnull[:-1]]
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(runs, at, 0)) + np.where(isnull, NULLS, 0)


class Shard:
    """One shard read back: keyed access through the index, and the ids of its documents in order."""

    def __init__(self, row: dict):
        self.n, self.width = row["n_docs"], row["width"]
        self.payload = row.get("payload")
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.seeds = np.frombuffer(row["seeds"], "<u4")
        self.offsets, self.lengths = np.frombuffer(row["offsets"], "<u8"), np.frombuffer(row["lengths"], "<u8")
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.null_key = row["null_key"]

    def slots(self, keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 where the stored fingerprint, or else the key itself, differs."""
        h = _hash(keys, occurrence)
        seeds = self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)]
        at = _slot(h, seeds, self.n)
        return np.where((self.prints[at] == (h >> np.uint64(32)).astype(np.uint32)) & (self.keys[at] == keys), at, -1)

    def slot(self, key: int | None, occurrence: int = 0) -> int:
        """The slot of one key, or -1."""
        if key is None and not self.null_key:
            return -1
        return int(self.slots(np.array([NULL_KEY if key is None else key], np.int64), np.array([occurrence + (NULLS if key is None else 0)]))[0])

    def find(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one key, or None."""
        at = self.slot(key, occurrence)
        return None if at < 0 else self._ids(at)

    def _ids(self, at: int) -> np.ndarray:
        kind = "<u2" if self.width == 2 else "<u4"
        return np.frombuffer(self.payload, kind, int(self.lengths[at]), int(self.offsets[at]) * self.width)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start in the shard, ids) of every document, each found through the index."""
        keys = self.keys[np.argsort(self.offsets, kind="stable")]  # no document is without ids: the end id
        n_null = 0
        while self.null_key and n_null < self.n and self.slot(None, n_null) >= 0:
            n_null += 1
        nulls = np.arange(self.n) < n_null
        at = self.slots(keys, _occurrences(keys, nulls.tolist()))
        for key, null, slot in zip(keys.tolist(), nulls, at.tolist(), strict=True):
            yield (None if null else key), int(self.offsets[slot]), self._ids(slot)


@lru_cache(maxsize=2)
def _table(path: str, width: int) -> Table:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    kind = np.dtype("<u2" if width == 2 else "<u4")

    feed = own.encode("\n", add_special_tokens=False).ids

    def encode(pieces: list[str]) -> list[bytes]:
        """Ids of each piece.  Those without white space inside, but for lone line feeds, share a line-fed text."""
        out: list[bytes] = [b""] * len(pieces)
        simple = [k for k, p in enumerate(pieces) if _LINED(p) and not any(t in p for t in special)] if len(feed) == 1 else []
        for at in range(0, len(simple), LINES):
            some = simple[at : at + LINES]
            (coded,) = own.encode_batch_fast(["\n".join([pieces[k] for k in some])], add_special_tokens=False)
            ids = np.array(coded.ids, kind)
            feeds = np.flatnonzero(ids == feed[0])
            last = np.cumsum([pieces[k].count("\n") + 1 for k in some])[:-1] - 1
            raw, begin = ids.tobytes(), 0
            for k, end in zip(some, [*(feeds[last] * width).tolist(), len(raw)], strict=True):
                out[k] = raw[begin:end]
                begin = end + width
        odd = [k for k in range(len(pieces)) if not out[k]]
        for k, coded in zip(odd, own.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(coded.ids, kind).tobytes()
        return out

    return Table(encode, CACHE_PIECES)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, vocabulary: int, key: str = "doc_id") -> None:
    """Encode every whole text, append ``end_id``, and write the file at ``path``.

    Parts are ranges of the key, cut at its approximate quantiles (a pass over the key column
    alone); any cuts give the same order, uneven ones only uneven parts.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = only(docs, **{key: "long", "text": "string"})
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, min(MOST_PARTS, -(-size // PART_BYTES))) if size else 1
    cuts = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]
    end = int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer_path, width)
        for batch in batches:
            for keys, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with gc_paused():
                    raw = [b"".join(found) + end for found in table.values(texts)]
                part = [0 if k is None else bisect.bisect_right(cuts, k) for k in keys]
                yield pa.record_batch(
                    [pa.array(part, pa.int32()), pa.array(keys, pa.int64()), pa.array(raw, pa.binary())], names=["part", key, "raw"]
                )

    coded = spread(rows).mapInArrow(encode, f"part int, {key} long, raw binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", key, "raw")
    shards = dealt.mapInArrow(_packer(width), SHARD_SCHEMA)
    shards.write.option("compression", "uncompressed").parquet(path)


def _packer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
        part, shard, before, held, size = None, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "local_start": before} | pack(held, width)
            return pa.record_batch([pa.array([row[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for p, key, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(raw) // width
                if held and (p != part or size + n > SHARD_TOKENS or len(held) >= SHARD_DOCS):
                    yield close()
                    shard, before, held, size = shard + 1, before + size, [], 0
                if p != part:
                    part, shard, before = p, 0, 0
                held.append((key, raw))
                size += n
        if held:
            yield close()

    return run


def _with_base(spark: SparkSession, path: str) -> DataFrame:
    """The shards and ``base``, the ids before each; sums are taken a part (there are few), then joined."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return shards.join(F.broadcast(base), "part").withColumn("base", F.col("before") + F.col("local_start"))


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                found = [
                    (k, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for k, start, ids in Shard(row).documents()
                ]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[key, "start", "n_tokens", "ids_crc32"])

    shards = _with_base(spark, path).drop("part", "shard", "least", "most", "local_start", "before", "n_tokens")
    return shards.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """(key, ids) of the stated keys, first occurrences.

    Shards whose range of keys holds none of them are left out by the reader; the others answer from their
    index alone; then the payloads of the shards that hold a key are read.
    """
    sought = sorted({NULL_KEY if k is None else k for k in keys})
    nulls = None in keys
    plain = {k for k in keys if k is not None}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                low, high = bisect.bisect_left(sought, row["least"]), bisect.bisect_right(sought, row["most"])
                own = [k for k in sought[low:high] if k in plain] + [None] * (nulls and shard.null_key)
                found = [(k, at) for k in own if (at := shard.slot(k)) >= 0]
                columns = [[k for k, _ in found], [row["part"]] * len(found), [row["shard"]] * len(found), [int(shard.offsets[at]) for _, at in found], [int(shard.lengths[at]) for _, at in found]]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["key", "part", "shard", "begin", "n"])

    shards = spark.read.parquet(path)
    # a key lies in a range of shards; ranges of many keys are one range
    some = F.lit(False)
    for at in range(0, len(sought), max(1, -(-len(sought) // 64))):
        chunk = sought[at : at + max(1, -(-len(sought) // 64))]
        some = some | ((F.col("most") >= chunk[0]) & (F.col("least") <= chunk[-1]))
    index = shards.where(some).drop("payload", "local_start", "n_tokens")
    found = index.mapInArrow(held, "key long, part long, shard long, begin long, n long")
    found = found.groupBy("key").agg(F.min(F.struct("part", "shard", "begin", "n")).alias("at")).select("key", "at.*")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                kind = "<u2" if row["width"] == 2 else "<u4"
                out.append(np.frombuffer(row["payload"], kind, row["n"], row["begin"] * row["width"]).tolist())
            yield pa.record_batch([batch.column("key"), pa.array(out, pa.list_(pa.int64()))], names=["key", "ids"])

    met = found.join(shards.select("part", "shard", "width", "payload"), ["part", "shard"])
    return met.select("key", "width", "payload", "begin", "n").mapInArrow(ids, "key long, ids array<long>")


def digests(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, key: str = "doc_id") -> DataFrame:
    """Write the file in the shared folder and read it back: a row per document."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, tokenizer_path, path, end_id, vocabulary, key)
    return read(spark, path, key)
