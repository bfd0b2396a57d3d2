"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is r times its size is to be taken r times.  The whole part is
taken outright; the fractions are rounded together.  Two documents at a time, mass moves between their
fractions, in words, until one of them is 0 or 1: the direction is drawn so that each keeps its
expectation, and the words of the pair stay what they were.  A run of documents ends with one open
fraction; the open ones of many runs meet in the next level of the tree, until a source has one left.
That one is often long, so some short documents of a source wait for it, about ``CHANGE`` and at most about a
``WAITING`` share of all: it is drawn by its fraction, and the mass it gains or loses is taken from all their
fractions in proportion, as far as it reaches; then the longest of them is drawn in the same way, and so on.
A source misses its target by less than its shortest waiting document where their mass suffices, and
by less than the open document otherwise.

Runs hold about ``RUN`` documents, so a source with a third of all rows spreads over as many tasks as
its rows need.  Draws come from hashes of the documents and of their number among rows alike, so reruns
agree and copies are drawn one by one.

Targets: the sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target
stops at 3 times its source's words and the rest is shared again by weight.

Defined results: null text has size 0 and takes nothing; very long texts are one document of their size;
repeated rows are taken one by one; a null source is a source; an empty table gives an empty result; other
columns are kept by ``mix`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needlework.llm.common import WORD, row_hash, stage
from needlework.plans.layout import spread

WEIGHTS = (1, 2, 3)
MOST = 3
RUN = 500
CHANGE = 64
WAITING = 0.125
#: Copies of one row that a task makes.
ALIKE = 1000
SEED = 20_24


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, held at MOST times the size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # sources may be many: ranges of them are numbered apart, after the sources of the ranges before
    ranged = stage(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    held = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    per = ranged.join(held.select("range", before.alias("before")), "range")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    listed = stage(per.select("source", "source_size", weight.cast("double").alias("weight")), "mix-sources")
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    # sources fill up in the order of size by weight; each round holds those that the level passes
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * level >= MOST * F.col("source_size")
        caps, free, n = listed.agg(
            F.sum(F.when(full, MOST * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n == held or not free:
            break
        held, level = n, (total - (caps or 0)) / free
    return listed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (MOST * F.col("source_size")).cast("double")).alias("target"))


ROW = "tie long, doc_id long, row_hash long, source string, size long, source_size long, target double, copies int, p double, u array<double>"


def _rounded(level: int):
    """Settle all but the last open fraction of every run; the rows arrive sorted by run."""
    names = ["run", *[c.strip().split()[0] for c in ROW.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open row: (its run, its one-row batch, size, p)

        def row(batch: pa.RecordBatch, extra: int, p: float) -> pa.RecordBatch:
            columns = {n: batch.column(n) for n in names[1:]}
            columns["copies"] = pa.array([batch.column("copies")[0].as_py() + extra], pa.int32())
            columns["p"] = pa.array([p], pa.float64())
            return pa.record_batch(list(columns.values()), names=names[1:])

        for batch in batches:
            runs = batch.column("run").to_pylist()
            size = batch.column("size").to_numpy().astype(np.float64)
            p = batch.column("p").to_numpy().copy()
            u = [x[level] for x in batch.column("u").to_pylist()]
            extra = np.zeros(len(runs), np.int32)
            at = None  # the open row, if it is of this batch
            for j in range(len(runs)):
                if at is None and held is not None and held[0] != runs[j]:
                    yield row(held[1], 0, held[3])
                    held = None
                elif at is not None and runs[at] != runs[j]:
                    at = None  # stays open
                if at is None and held is None:
                    at = j
                    continue
                a, pa_ = (size[at], p[at]) if at is not None else held[2:]
                b, pb = size[j], p[j]
                up, down = min((1 - pa_) * a, pb * b), min(pa_ * a, (1 - pb) * b)  # words that may move to, from the open row
                if u[j] * (up + down) < down:
                    move, whole_a, whole_b = up, (1 - pa_) * a <= pb * b, (1 - pa_) * a >= pb * b
                    pa_, pb = (1.0 if whole_a else pa_ + move / a), (0.0 if whole_b else pb - move / b)
                else:
                    move, whole_a, whole_b = down, pa_ * a <= (1 - pb) * b, pa_ * a >= (1 - pb) * b
                    pa_, pb = (0.0 if whole_a else pa_ - move / a), (1.0 if whole_b else pb + move / b)
                settled_a, settled_b = pa_ in (0.0, 1.0), pb in (0.0, 1.0)
                if at is not None:
                    p[at], extra[at] = (0.0, int(pa_)) if settled_a else (pa_, 0)
                else:
                    held = (held[0], held[1], held[2], pa_)
                    if settled_a:
                        yield row(held[1], int(pa_), 0.0)
                        held = None
                p[j], extra[j] = (0.0, int(pb)) if settled_b else (pb, 0)
                if settled_a:
                    at = None if settled_b else j
            columns = {n: batch.column(n) for n in names[1:]}
            columns["copies"] = pa.array(batch.column("copies").to_numpy() + extra, pa.int32())
            columns["p"] = pa.array(p, pa.float64())
            done = pa.record_batch(list(columns.values()), names=names[1:])
            if at is None:
                yield done
            else:
                held = (runs[at], done.slice(at, 1), size[at], p[at])
                yield done.slice(0, at)
                yield done.slice(at + 1)
        if held is not None:
            yield row(held[1], 0, held[3])

    return run


def _settled(rows):
    """The last open documents of one source (at most a few times CHANGE), the longest first."""
    rows = rows.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, p = rows["size"].to_numpy(float), rows["p"].to_numpy(float).copy()
    extra = np.zeros(len(rows), np.int32)
    for i in range(len(rows)):
        rest = slice(i + 1, None)
        held, room = float(p[rest] @ size[rest]), float((1 - p[rest]) @ size[rest])
        gain, loss = (1 - p[i]) * size[i], p[i] * size[i]
        taken = rows["u"][i][LEVELS - 1] < p[i]
        if held >= gain and room >= loss:
            if taken:
                p[rest] *= 1 - gain / held if held else 1
            else:
                p[rest] += (1 - p[rest]) * (loss / room if room else 0)
        elif len(rows) - i > 1:  # as far as the change reaches
            if taken:
                p[rest] *= max(0.0, 1 - gain / held) if held else 1
            else:
                p[rest] += (1 - p[rest]) * (min(1.0, loss / room) if room else 0)
        extra[i] = int(taken)
    rows["copies"] = (rows["copies"].to_numpy() + extra).astype(np.int32)
    rows["p"] = 0.0
    return rows


LEVELS = 8


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """A row per document: tie, doc_id, row_hash, source, size, source_size, target, copies."""
    spark = docs.sparkSession
    draws = [
        (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + level), "doc_id", "row_hash", "nth"), 11) * F.lit(2.0**-53)).alias(f"u{level}")
        for level in range(LEVELS)
    ]
    rows = spread(docs.select(F.col(key).alias("__key"), F.col(source).alias("__source"), F.col("text").alias("__text"), row_hash(docs).alias("__hash")))
    sized = rows.select(
        F.col("__key").cast("long").alias("doc_id"), F.col("__source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("__text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col("__hash").alias("row_hash"),
    )
    # rows alike are counted, then numbered; a row each again, without its text
    alike = sized.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("n"))
    narrow = stage(alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n"), "mix-sizes")
    targets = source_targets(narrow)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(MOST))
    open_ = narrow.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.xxhash64(F.lit(SEED), "doc_id", "row_hash", "nth").alias("tie"), "doc_id", "row_hash", "source", "size", "source_size", "target",
        whole.cast("int").alias("copies"), F.when(F.col("size") > 0, ratio - whole).otherwise(0.0).alias("p"),
        F.array(*[d.alias(f"u{i}") for i, d in enumerate(draws)]).alias("u"),
    )
    open_ = stage(open_, "mix-open")
    per = open_.groupBy("source").agg(F.count("*").alias("docs"), F.avg("size").alias("mean")).withColumnRenamed("source", "s")
    share = F.least(F.lit(2.0 * CHANGE) / F.col("docs"), F.lit(2 * WAITING))  # of those up to the mean, about half of all
    small = (F.col("size") <= F.col("mean")) & (F.pmod(F.shiftright("tie", 20), F.lit(1 << 20)) < share * (1 << 20))
    names = [c.strip().split()[0] for c in ROW.split(",")]
    open_ = stage(open_.join(per, F.col("source").eqNullSafe(F.col("s"))).select(*names, ((F.col("p") > 0) & small).alias("waits")), "mix-open")
    waiting, settled = open_.where("waits").select(*names), [open_.where("p = 0").select(*names)]
    open_ = open_.where("p > 0 and not waits").select(*names)
    for level in range(LEVELS):
        counts = stage(open_.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), "n"), "mix-counts")
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        runs = F.ceil(F.col("n") / RUN)
        dealt = open_.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("run", F.xxhash64("source", F.pmod(F.shiftright("tie", 7), runs)))
        sorted_ = dealt.select("run", *names).repartition("run").sortWithinPartitions("run", "source", "tie", "size")
        done = stage(sorted_.mapInArrow(_rounded(level), ROW), "mix-open")
        settled.append(done.where("p = 0"))
        open_ = done.where("p > 0")
    out = open_.union(waiting).groupBy("source").applyInPandas(_settled, ROW)
    for part in settled:
        out = out.union(part)
    return out.select("doc_id", "row_hash", "source", "size", "source_size", "target", "copies")


def report(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return plan(docs, key, source).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents, all their columns, each as often as the mix takes it.

    Decisions meet rows by key and a hash of the whole row, so rows that share both are alike and
    any of them stands for all.
    """
    columns = docs.columns
    takes = plan(docs, key, source).groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("__takes"), F.count("*").alias("__alike"))
    takes = takes.select(F.col("doc_id").alias("__key"), F.col("row_hash").alias("__hash"), "__takes", "__alike")
    rows = docs.withColumn("__row_hash", row_hash(docs))
    met = rows.join(takes, F.col(key).cast("long").eqNullSafe(F.col("__key")) & (F.col("__row_hash") == F.col("__hash")))
    once = met.where("__alike = 1").withColumn("__n", F.col("__takes"))
    # of rows alike one stands for all; its copies are dealt out ALIKE at a time
    one = met.where("__alike > 1").dropDuplicates(["__key", "__hash"])
    dealt = one.withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__takes") / ALIKE))))
    many = dealt.withColumn("__n", F.least(F.lit(ALIKE), F.col("__takes") - F.col("__deal") * ALIKE)).where("__n > 0").repartition("__hash", "__deal")
    picked = [*[F.col(f"`{c}`") for c in columns], F.col("__n")]
    both = once.select(*picked).union(many.select(*picked)).where("__n > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
