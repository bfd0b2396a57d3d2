"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

Equal fingerprints are one class, so copies never meet in pairs.  The 64 bits form a ring of
tau + 1 segments.  If two fingerprints differ in at most tau bits, some chain of consecutive segments
keeps every prefix of l segments within l * tau / (tau + 1) differing bits, rounded down: for tau = 4
and 5 segments 0, 1, 2, 3, 4.  The first two links make a join key (a segment that agrees, the next one
with at most one flipped bit, enumerated on one side); the other links prune what the key brings
together, and the full Hamming distance decides.

A key's fingerprints are compared in blocks, those of a dense key in several tasks, and a dense key emits
only links that join its own components, so a group of G near copies costs G rows, not G * G.  A
fingerprint goes by its smallest key, so components come out of the star contraction, over staged
tables, under the key they are to have.

Defined results: null or empty texts have fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; very long texts are taken whole, their shingles in runs of ``BLOCK_SHINGLES``;
repeated rows share their class; null keys get a component but never name one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.common import connected_components, drop, numbered, only, row_hash, stage
from needlework.plans.layout import spread

SEED = 42
#: Shingles whose bits are counted together.
BLOCK_SHINGLES = 1 << 15
#: Pairs of one key compared together.
PAIRS = 1 << 20
#: Fingerprints of one key that a task takes; those of a denser key are dealt out as pairs of blocks.
BLOCK = 8192
#: Bits of a join key, and of a block's number, in the number of a task.
KEY_BITS, BLOCK_BITS = 29, 17


def fingerprint(text: str | None, words_each: int = 4) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - words_each + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(words_each, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK_SHINGLES):
        some = zip(first[at : at + BLOCK_SHINGLES], last[at : at + BLOCK_SHINGLES], strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in some], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", words_each: int = 4, *also: str) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a long; further long columns ride along."""
    rows = spread(only(docs, **{key: "long", "text": "string"} | dict.fromkeys(also, "long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words_each) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]], names=[key, "fp", *also])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (key, "fp", *also)))


def _segments(tau: int) -> list[tuple[int, int]]:
    """(shift, width) of the tau + 1 segments, as even as may be."""
    m = tau + 1
    wide = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(wide[:i]), w) for i, w in enumerate(wide)]


def _keyed(prints: DataFrame, tau: int, flipped: bool = True) -> DataFrame:
    """(key, fp, node): a row for the segment pair at each place of the ring, and one for each flip of its second."""
    parts = _segments(tau)
    rows = []
    for i, (shift, width) in enumerate(parts):
        shift2, width2 = parts[(i + 1) % len(parts)]
        first = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned("fp", shift2).bitwiseAND(F.lit((1 << width2) - 1))
        base = first * (1 << 13) + second + (i << 26)
        flips = [0, *[1 << b for b in range(width2)]] if tau and flipped else [0]
        rows.append(F.array(*[base.bitwiseXOR(F.lit(f)) for f in flips]))
    return prints.select("fp", "node", F.explode(F.concat(*rows)).alias("key")).select(F.col("key").cast("int").alias("key"), "fp", "node")


def _near(own: np.ndarray, other: np.ndarray, place: np.ndarray, tau: int) -> np.ndarray:
    """Whether each pair keeps the chain that begins at ``place`` and the full distance."""
    parts = _segments(tau)
    shift, width = (np.array([p[k] for p in parts], np.uint64) for k in (0, 1))
    diff = own ^ other
    ok = np.ones(len(diff), bool)
    total = np.zeros(len(diff), np.int64)
    for step in range(len(parts)):
        at = (place + step) % len(parts)
        total += np.bitwise_count((diff >> shift[at]) & ((np.uint64(1) << width[at]) - np.uint64(1)))
        ok &= total <= (step + 1) * tau // len(parts)
    return ok


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links (a, b): each node to the least of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _linker(tau: int):
    """From rows (task, side, fp, node) sorted by task to links (a, b) of nodes that connect what the keys' pairs connect."""
    parts = _segments(tau)

    def links(task: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links among whole groups of equal tasks, in blocks of at most about PAIRS pairs."""
        key = task & ((1 << KEY_BITS) - 1)
        place = key >> 26
        shift2 = np.array([parts[(i + 1) % len(parts)][0] for i in range(len(parts))], np.uint64)[place]
        width2 = np.array([parts[(i + 1) % len(parts)][1] for i in range(len(parts))], np.uint64)[place]
        second = ((fp >> shift2) & ((np.uint64(1) << width2) - np.uint64(1))).astype(np.int64)
        exact = second == (key & 8191)  # the row whose own segments are the key's
        order = np.lexsort((~exact, side, task))
        task, side, fp, node, exact, place = (x[order] for x in (task, side, fp, node, exact, place))
        at = np.arange(len(task))
        begins, ends = np.searchsorted(task, task), np.searchsorted(task, task, side="right")
        middle = begins + np.add.reduceat(side == 0, np.unique(begins))[np.searchsorted(np.unique(begins), begins)]
        # a whole key: what follows; two blocks of one: the other block
        crossed = middle < ends
        lower = np.where(crossed, np.where(side == 0, middle, begins), at + 1)
        upper = np.where(crossed & (side == 1), middle, ends)
        own = np.flatnonzero(exact & (upper > lower))
        count = (upper - lower)[own]
        begin, gathered = 0, ([], [], 0)
        while begin < len(own):
            upto = begin + max(1, int(np.searchsorted(np.cumsum(count[begin : begin + PAIRS]), PAIRS)))
            some, n = own[begin:upto], count[begin:upto]
            left = np.repeat(some, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lower[some], n)
            ok = _near(fp[left], fp[right], place[left], tau)
            if ok.any():
                gathered[0].append(node[left[ok]])
                gathered[1].append(node[right[ok]])
                gathered = (*gathered[:2], gathered[2] + int(ok.sum()))
            if gathered[2] > PAIRS:
                a, b = _forest(np.concatenate(gathered[0]), np.concatenate(gathered[1]))
                gathered = ([a], [b], len(a)) if len(a) < PAIRS // 2 else ([], [], 0)
                if not gathered[0]:
                    yield a, b
            begin = upto
        if gathered[0]:
            yield _forest(np.concatenate(gathered[0]), np.concatenate(gathered[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def columns() -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*held, strict=True)]

        def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in links(*rows):
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()])
            size += batch.num_rows
            if size < 1 << 18:
                continue
            rows = columns()
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group, of 2 * BLOCK rows at most, may go on
            if whole:
                yield from out([x[:whole] for x in rows])
            held, size = [[x[whole:] for x in rows]], len(rows[0]) - whole
        if held:
            yield from out(columns())

    return run


def _dense(classes: DataFrame, tau: int) -> DataFrame:
    """(key, blocks) of the join keys that over BLOCK fingerprints share.

    Only the keys of the fingerprints' own segments are counted, five rows each; a key's flipped rows are
    those of the keys one bit away.
    """
    wide = max(w for _, w in _segments(tau))
    own = _keyed(classes.select("fp", "node"), tau, False).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * (wide + 1) > BLOCK)
    near = F.explode(F.array(F.col("key"), *[F.col("key").bitwiseXOR(F.lit(1 << b)) for b in range(wide)]))
    return own.select(near.alias("key"), "n").groupBy("key").agg(F.ceil((F.sum("n") + F.lit(BLOCK)) / BLOCK).cast("int").alias("blocks"))


def components(prints: DataFrame, tau: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) of (key, fp): the smallest key that links of at most tau bits reach."""
    if tau != 4:
        raise ValueError("segments of 13 bits, as the join key holds them, are those of tau = 4")
    classes, top = numbered(prints.groupBy("fp").agg(F.min(key).alias("rep")), "rep", "simhash-classes")
    keyed = _keyed(classes.select("fp", "node"), tau)
    dense = stage(_dense(classes, tau), "simhash-dense")
    if dense.isEmpty():
        tasks = keyed.select(F.col("key").cast("long").alias("task"), F.lit(0).alias("side"), "fp", "node")
    else:
        # block k of a key meets itself, the blocks after it as side 0, and those before it as side 1
        met = keyed.join(dense, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        met = met.withColumn("k", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        low, high = F.least("k", "other"), F.greatest("k", "other")
        task = F.col("key").cast("long").bitwiseOR(F.shiftleft(low, KEY_BITS)).bitwiseOR(F.shiftleft(high, KEY_BITS + BLOCK_BITS))
        tasks = met.select(task.alias("task"), (F.col("k") > F.col("other")).cast("int").alias("side"), "fp", "node")
    sorted_ = tasks.repartition("task").sortWithinPartitions("task")
    links = stage(sorted_.mapInArrow(_linker(tau), "a long, b long").distinct(), "simhash-links")
    joined = connected_components(links, "simhash-components")
    component = F.coalesce("component", "node")
    final = classes.join(joined, "node", "left").select("fp", F.when(component <= top, component).alias("component_id"))
    drop(links, dense)
    return prints.join(final, "fp").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, tau: int = 4, words_each: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every document."""
    prints = stage(fingerprints(docs, key, words_each), "simhash-prints")
    found = components(prints, tau, key)
    return found.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame, key: str = "doc_id", tau: int = 4, words_each: int = 4) -> DataFrame:
    """The documents, all their columns, one of each group: the smallest key (a null key last), then the least row hash."""
    columns = docs.columns
    rows = docs.withColumn("__hash", row_hash(docs))
    prints = stage(fingerprints(rows, key, words_each, "__hash"), "simhash-prints")
    grouped = components(prints.select("fp").distinct().select(F.col("fp").alias("row"), "fp"), tau, "row").select("fp", F.col("component_id").alias("group"))
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("__hash").alias("h"))
    # copies share a fingerprint: its least row first, then that of the group
    leading = prints.groupBy("fp").agg(F.min(order).alias("first")).join(grouped, "fp")
    firsts = leading.groupBy("group").agg(F.min("first").alias("first")).select("first.k", "first.h")
    alike = prints.groupBy(F.col(key).alias("k"), F.col("__hash").alias("h")).agg(F.count("*").alias("n"))
    same = firsts["k"].eqNullSafe(alike["k"]) & (firsts["h"] == alike["h"])
    firsts = stage(firsts.join(alike, same).select(firsts["k"].alias("__k"), firsts["h"].alias("__h"), F.col("n").alias("__alike")), "simhash-firsts")
    met = rows.join(firsts, F.col(key).cast("long").eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__h")))
    again = met.where("__alike > 1").dropDuplicates(["__k", "__h"])  # rows alike in every column: one a task meets the others
    return met.where("__alike = 1").select(*columns).union(again.select(*columns))
