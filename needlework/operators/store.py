"""Interning, memoised search and dedup figures: content is the key, never a hash alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.functions import search
from needlework.operators.repeats import Options, repeats
from needlework.plans.staging import stage


def intern(hays: DataFrame) -> DataFrame:
    """(handle, text, refs): one row a distinct content; the handle is its smallest hay_id."""
    return hays.groupBy("text").agg(F.min("hay_id").alias("handle"), F.count("*").alias("refs")).select("handle", "text", "refs")


def release(store: DataFrame, handles: DataFrame) -> DataFrame:
    """The store after one release of each row of (handle); contents without references go."""
    gone = handles.groupBy("handle").agg(F.count("*").alias("gone"))
    left = store.join(gone, "handle", "left").withColumn("refs", F.col("refs") - F.coalesce("gone", F.lit(0)))
    return left.where("refs > 0").select("handle", "text", "refs")


def handles(hays: DataFrame) -> DataFrame:
    """(hay_id, handle): the interned content of each haystack.  Contents meet by a hash and are compared whole."""
    keyed = hays.select("hay_id", "text", F.xxhash64("text").alias("key"))
    first = keyed.groupBy("key", "text").agg(F.min("hay_id").alias("handle"))
    again = first.select(F.col("key").alias("__key"), F.col("text").alias("__text"), "handle")
    return keyed.join(again, (F.col("key") == F.col("__key")) & F.col("text").eqNullSafe(F.col("__text"))).select("hay_id", "handle")


def memo(hays: DataFrame, **columns) -> DataFrame:
    """(hay_id, columns): expressions of ``text``.

    A native search costs less than bringing equal texts together, so each row is searched where it is; what
    costs more is computed once a content with ``once``.
    """
    return hays.select("hay_id", *[c.alias(n) for n, c in columns.items()])


def once(hays: DataFrame, find) -> DataFrame:
    """``find``'s rows (hay_id, ...) for every haystack, found once a distinct content; null texts have none."""
    known = stage(handles(hays.where("text is not null")), "store-handles")
    distinct = hays.where("text is not null").join(known.where("hay_id = handle").select("hay_id").distinct(), "hay_id").dropDuplicates(["hay_id"])
    found = find(distinct.select("hay_id", "text")).withColumnRenamed("hay_id", "handle")
    others = [c for c in found.columns if c != "handle"]
    return known.join(found, "handle").select("hay_id", *others)


def repeats_in(hays: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(hay_id, off, len, n, est_lin, sub): the repeats of each haystack, searched once a distinct content."""
    return once(hays, lambda rows: repeats(rows, options))


def memo_find(hays: DataFrame, needle: str) -> DataFrame:
    return memo(hays, off=search.find("text", needle))


def memo_count(hays: DataFrame, needle: str, overlap: bool = False) -> DataFrame:
    return memo(hays, n=search.count("text", needle, overlap))


MEMO = "handle long, needle string, off long, n long"


def remember(store: DataFrame, needles: list[str], memo_path: str | None = None) -> DataFrame:
    """(handle, needle, off, n) of a store's contents for the stated needles, as a table to keep.

    What the table at ``memo_path`` already knows is taken from there, by handle and needle; the rest is
    searched.  Save the result with ``save`` and pass its path the next time.
    """
    spark = store.sparkSession
    known = spark.read.schema(MEMO).parquet(memo_path) if memo_path else spark.createDataFrame([], MEMO)
    sought = F.explode(F.array(*map(F.lit, dict.fromkeys(needles))) if needles else F.expr("cast(array() as array<string>)"))
    pairs = store.where("text is not null").select(F.col("handle").cast("long").alias("handle"), sought.alias("needle"))
    held = pairs.join(known, ["handle", "needle"])
    new = pairs.join(known, ["handle", "needle"], "left_anti")
    met = new.join(store.select(F.col("handle").cast("long").alias("handle"), "text"), "handle")
    return held.select("handle", "needle", "off", "n").union(
        met.select("handle", "needle", search.find("text", F.col("needle")).alias("off"), search.count("text", F.col("needle")).alias("n"))
    )


def stats(hays: DataFrame) -> DataFrame:
    """One row: contents, references, raw and resident bytes."""
    size = F.octet_length("text")
    return intern(hays).agg(
        F.count("*").alias("objects"), F.sum("refs").alias("refs"), F.sum(size * F.col("refs")).alias("raw_bytes"), F.sum(size).alias("resident_bytes")
    )


def stats_json(hays: DataFrame) -> DataFrame:
    """The same as one JSON line, with the ratio of raw to resident bytes."""
    ratio = F.round(F.col("raw_bytes") / F.col("resident_bytes"), 6)
    return stats(hays).withColumn("dedup_ratio", ratio).select(F.to_json(F.struct("*")).alias("json"))


def read_range(hays: DataFrame, off: int, length: int) -> DataFrame:
    """(hay_id, bytes): a byte range of each content."""
    return hays.select("hay_id", F.substring(F.encode("text", "UTF-8"), off + 1, length).alias("bytes"))


def save(store: DataFrame, path: str) -> None:
    """A snapshot as Parquet; what was released is not in it."""
    store.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
