"""Shared pieces of the training-data operators: columns, row hashes, components; staged tables come from the core."""

from __future__ import annotations

import contextlib
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.plans.staging import drop, shared_dir, stage

__all__ = ["BLANK", "WORD", "connected_components", "drop", "free_shuffles", "gc_paused", "numbered", "only", "row_hash", "shared_dir", "stage", "table"]

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` leaves it out.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def gc_paused():
    """No garbage collection meanwhile: a worker's tables hold no cycles, and are costly to walk."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names cannot disturb a plan."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in columns.items()])


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, nulls marked."""
    values = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*values, *[v.isNull() for v in values])


def free_shuffles(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the shuffle files of plans that nothing refers to any more, before the next phase writes its own."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(classes: DataFrame, least: str, label: str) -> tuple[DataFrame, int]:
    """(``classes`` staged with ``node``, the largest id): a class goes by its least id, one with null ids alone by a number above all ids.

    So the smallest node of a component is the id that names it, or is above the largest id and names nothing.
    """
    staged = stage(classes, label)
    top, nulls = staged.agg(F.max(least), F.count_if(F.col(least).isNull())).first()
    top = -(2**63) if top is None else top
    if not nulls:
        return staged.withColumn("node", F.col(least)), top
    if top >= 2**62:
        raise OverflowError("no numbers are left above the ids for the classes of null ids")
    above = F.lit(max(top, 0) + 1) + F.monotonically_increasing_id()
    out = stage(staged.withColumn("node", F.coalesce(F.col(least), above)), label)
    drop(staged)
    return out, top


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that links reach.

    Alternating large-star and small-star steps over staged edge tables.  A node's smallest
    neighbour comes from a pre-aggregated ``min``; hubs meet their edges in a plain join that
    adaptive execution may split, so no task needs all neighbours of one node.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # the key is written anew, so that both sides are dealt out for this join and a hub's edges may be split
        again = least.select(F.col("a").bitwiseXOR(F.lit(0)).alias("hub"), "m")
        met = both.join(again, both["a"] == again["hub"])
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stage(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), label
    )
    seen = state(now)
    while seen[0]:
        before, now = now, stage(star(star(now, True), False), label)
        drop(before)
        after = state(now)
        if after == seen:
            break
        seen = after
    leaves = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = stage(leaves.union(roots), label)
    drop(now)
    return out
