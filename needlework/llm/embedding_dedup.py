"""Embedding near-duplicates: a forest of random-projection trees with spill overlap.

Equal vectors are one class.  A tree splits the space again and again: each level has a random
direction, each node a threshold, the median of a bounded sample's projections (``SAMPLE`` vectors); a
vector within ``SPILL`` of the threshold goes both ways.  Below ``SAMPLED`` levels a node has too little of
the sample, and the median of the whole sample stands in, so a forest's size does not grow with the
data.  Depth grows with the number of classes, so a leaf holds about ``LEAF`` of them.  Vectors are
compared inside leaves, in blocks, in double precision: the cosine decides, so no link below the bound is
ever reported; what a tree separates, others find.

A pair counts only in the first leaf that its two vectors share, which a task finds from the forest
itself.  So links are counted without listing pairs, and a leaf reports one row a vector and the links that
join its components.  A leaf of more than ``BLOCK`` vectors is dealt out as pairs of blocks.  A class goes
by its least id, so components come out of the star contraction under the id they are to have.

Defined results: vectors that are null, zero, or hold null or non-finite parts link with nothing; vectors
of different lengths never link; repeated rows are copies and link; a null id counts as a copy but names
no component; an empty table gives an empty result; other columns, labels among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.common import connected_components, drop, free_shuffles, numbered, stage
from needlework.llm.simhash import _forest

COSINE = 0.95
TREES = 4
LEAF = 512
SPILL = 0.02
SAMPLE = 20_000
#: Levels whose nodes have thresholds of their own: some forty vectors of the sample at the last.
SAMPLED = 9
BLOCK = 4096
SEED = 11
#: Pairs whose leaves are compared together.
PAIRS = 1 << 16


class Forest:
    """Directions of each level and thresholds of each node, for every tree; of no level (one leaf) without a sample."""

    def __init__(self, sample: np.ndarray | None, depth: int):
        rng = np.random.default_rng(SEED)
        self.depth, self.trees = depth, TREES if depth else 1
        self.directions, self.thresholds = [], []
        for _ in range(self.trees if depth else 0):
            r = rng.standard_normal((depth, sample.shape[1]))
            r /= np.linalg.norm(r, axis=1, keepdims=True)
            p, node, levels = sample @ r.T, np.zeros(len(sample), np.int64), []
            for level in range(depth):
                if level >= SAMPLED:
                    levels.append(np.median(p[:, level]))
                    continue
                order = np.lexsort((p[:, level], node))
                bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
                middle = (bounds[:-1] + bounds[1:]) // 2
                full = bounds[1:] > bounds[:-1]
                at = np.full(1 << level, np.median(p[:, level]))
                at[full] = p[order[middle[full]], level]
                levels.append(at)
                node = node * 2 + (p[:, level] >= at[node])
            self.directions.append(r)
            self.thresholds.append(levels)

    def leaves(self, unit: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf of one tree that a row falls in; leaves of a tree come before the next tree's."""
        row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        p = unit @ self.directions[tree].T if self.depth else None
        for level in range(self.depth):
            at = self.thresholds[tree][level]
            off = p[row, level] - (at[node] if level < SAMPLED else at)
            left, right = off < SPILL, off >= -SPILL
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, (tree << self.depth) + node

    def listed(self, unit: np.ndarray, tree: int) -> np.ndarray:
        """The leaves of one tree as a table, a line a row, -1 where it has fewer."""
        row, leaf = self.leaves(unit, tree)
        order = np.argsort(row, kind="stable")
        row, leaf = row[order], leaf[order]
        begin = np.searchsorted(row, np.arange(len(unit) + 1))
        out = np.full((len(unit), int(np.diff(begin).max(initial=1))), -1, np.int64)
        out[row, np.arange(len(row)) - begin[row]] = leaf
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # huge or tiny parts keep their direction
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _dealer(forest: Forest, tree: int):
    """Rows (leaf, node, n, v): a class once for every leaf of one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, leaf = forest.leaves(_unit(_stack(batch.column("v"))), tree)
                at = pa.array(row)
                yield pa.record_batch([pa.array(leaf), *(batch.column(c).take(at) for c in ("node", "n", "v"))], names=["leaf", "node", "n", "v"])

    return run


def _counter(forest: Forest):
    """Rows (leaf, n): how many classes each leaf of all trees has in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_stack(batch.column("v")))
                leaf, n = np.unique(np.concatenate([forest.leaves(unit, tree)[1] for tree in range(forest.trees)]), return_counts=True)
                yield pa.record_batch([pa.array(leaf), pa.array(n.astype(np.int64))], names=["leaf", "n"])

    return run


class _Group:
    """The vectors of one task: a whole leaf, or two blocks of one."""

    def __init__(self, rows: pa.Table, forest: Forest):
        self.node, self.n = (rows.column(c).to_numpy() for c in ("node", "n"))
        self.unit = _unit(_stack(rows.column("v").combine_chunks()))
        self.leaf = rows.column("leaf")[0].as_py()
        self.cut = int((rows.column("side").to_numpy() == 0).sum())
        self.forest, self.tables = forest, {}

    def _table(self, tree: int) -> np.ndarray:
        if tree not in self.tables:
            self.tables[tree] = self.forest.listed(self.unit, tree)
        return self.tables[tree]

    def owned(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether this leaf is the first that the vectors of each pair share."""
        own, live = np.ones(len(x), bool), np.arange(len(x))
        if not self.forest.depth:
            return own  # one leaf has them all
        for tree in range((self.leaf >> self.forest.depth) + 1):
            a, b = self._table(tree)[x[live]], self._table(tree)[y[live]]
            met = np.zeros(len(live), bool)
            for column in a.T:
                before = (column >= 0) & (column < self.leaf)
                met |= before & (b == column[:, None]).any(axis=1)
            own[live[met]] = False
            live = live[~met]
        return own

    def links(self) -> pa.RecordBatch:
        """Rows (node, links) and rows (a, b): links counted by class, and links that connect the same."""
        size, cut, step = len(self.node), self.cut, 1024
        total, a_out, b_out = np.zeros(size, np.int64), [], []
        upto = lambda s, end: slice(s, min(s + step, end))
        if cut == size:  # a whole leaf or one block against itself
            pairs = [(upto(s, cut), upto(t, cut)) for s in range(0, cut, step) for t in range(s, cut, step)]
        else:
            pairs = [(upto(s, cut), upto(t, size)) for s in range(0, cut, step) for t in range(cut, size, step)]
        for first, second in pairs:
            i, j = np.nonzero(self.unit[first] @ self.unit[second].T >= COSINE)
            i, j = i + first.start, j + second.start
            if first == second:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                own = self.owned(x, y)
                np.add.at(total, x[own], self.n[y[own]])
                np.add.at(total, y[own], self.n[x[own]])
            a, b = _forest(self.node[i], self.node[j])
            a_out.append(a)
            b_out.append(b)
        hit = np.flatnonzero(total)
        a, b = _forest(np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, np.int64),) * 2
        none = lambda k: pa.nulls(k, pa.int64())
        counted, joined = (self.node[hit], total[hit]), (a, b)
        columns = [pa.concat_arrays([pa.array(c, pa.int64()), none(len(a))]) for c in counted] + [pa.concat_arrays([none(len(hit)), pa.array(c, pa.int64())]) for c in joined]
        return pa.record_batch(columns, names=["node", "links", "a", "b"])


def _linker(forest: Forest):
    """From rows sorted by (task, side, node) to the links of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task = None

        def close() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) > 1:
                yield _Group(pa.Table.from_batches(held), forest).links()
            held.clear()

        for batch in batches:
            keys = batch.column("task").to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if keys[lo] != task:
                    yield from close()
                    task = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        yield from close()

    return run


LINKS = "node long, links long, a long, b long"


def _compared(dealt: DataFrame, large: DataFrame | None, forest: Forest) -> DataFrame:
    """The links of (leaf, node, n, v), compared by leaf; ``large`` (leaf, blocks) has the leaves that are split, None if none is."""
    if large is None:
        spread = dealt.select(F.col("leaf").alias("task"), F.lit(0).alias("side"), "leaf", "node", "n", "v")
    else:
        # block k meets itself, the blocks after it as side 0, and those before it as side 1
        met = dealt.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        met = met.withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = met.select(
            F.xxhash64("leaf", F.least("k", "other"), F.greatest("k", "other")).alias("task"), (F.col("k") > F.col("other")).cast("int").alias("side"), "leaf", "node", "n", "v"
        )
    tasks = spread.repartition("task").sortWithinPartitions("task", "side", "node")
    return stage(tasks.mapInArrow(_linker(forest), LINKS), "rp-links")


def _pairs_of(classes: DataFrame, n: int, kind: str) -> list[DataFrame]:
    """(node, links, a, b) of each tree, staged; the copies of one tree are on disk at a time."""
    depth = int(np.ceil(np.log2(n / LEAF)))
    drawn = classes.orderBy(F.xxhash64(F.lit(SEED), "node")).limit(SAMPLE).select("v").collect()  # a bounded sample
    forest = Forest(_unit(np.array([r["v"] for r in drawn], np.float64)), depth)
    sizes = classes.mapInArrow(_counter(forest), "leaf long, n long").groupBy("leaf").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    large = stage(sizes.where("blocks > 1"), "rp-large")
    split = not large.isEmpty()
    out = []
    for tree in range(forest.trees):
        dealt = classes.mapInArrow(_dealer(forest, tree), f"leaf long, node long, n long, v array<{kind}>")
        out.append(_compared(dealt, large if split else None, forest))
        free_shuffles(classes.sparkSession)  # those of one tree before the next
    return out


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every vector."""
    v = F.col("v")
    kind = "float" if vectors.schema[column].dataType.elementType.simpleString() == "float" else "double"
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(column).cast(f"array<{kind}>").alias("v"))
    valid = rows.where(F.coalesce(good, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))
    alone = rows.where(~F.coalesce(good, F.lit(False))).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    classes, top = numbered(valid.groupBy("v").agg(F.min(key).alias("least"), F.count("*").alias("n")), "least", "rp-classes")
    narrow = classes.select("node", "n", "v")
    by_length = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("classes"))
    large = {r["dim"]: r["classes"] for r in by_length.where(F.col("classes") > LEAF).collect()}  # lengths of over LEAF vectors
    few = narrow.where(~F.size("v").isin(*large)) if large else narrow
    # every length of few vectors is a leaf by itself
    found = [_compared(few.select(F.size("v").cast("long").alias("leaf"), "node", "n", "v"), None, Forest(None, 0))]
    for dim, n in large.items():
        found += _pairs_of(narrow.where(F.size("v") == dim), n, kind)
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    per = links.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(links.where("a is not null").select("a", "b"), "rp-components")
    named = classes.join(per, "node", "left").join(joined, "node", "left")
    component = F.coalesce("component", "node")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(component <= top, component).alias("component_id"))
    final = stage(named, "rp-final")
    drop(*found)
    linked = valid.join(final, "v").select(key, "n_links", "component_id")
    return linked.union(alone).select(key, "n_links", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"))
