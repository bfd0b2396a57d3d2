"""All occurrences as rows: linear in their number, however many one text holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needlework.functions.search import _LEAD, quoted
from needlework.plans.layout import spread


def find_all_rows(hays: DataFrame, needles: list[str], overlap: bool = False, cap: int | None = None) -> DataFrame:
    """(hay_id, needle, off) of every occurrence of the stated needles, the first ``cap`` of each pair.

    Parts between occurrences are unfolded, and offsets are running sums of their lengths.  The empty
    needle has none; rows that share a hay_id are told apart.
    """
    stated = [n for n in dict.fromkeys(needles) if n]
    rows = spread(hays.where("text is not null").select("hay_id", "text")).select("hay_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("needle", F.explode(F.array(*map(F.lit, stated)) if stated else F.expr("cast(array() as array<string>)")))
    rows = rows.where(F.contains("text", "needle"))
    n = F.col("needle")
    if overlap:
        parts = F.split(F.concat(F.lit(_LEAD), F.col("text")), F.concat(F.lit("(?="), quoted(n), F.lit(")")), -1)
    else:
        parts = F.split("text", quoted(n), -1)
    unfolded = rows.select("hay_id", "row", "needle", F.posexplode(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))).alias("pos", "length"))
    before = Window.partitionBy("row", "needle").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    wide = -1 if overlap else F.col("pos") * F.length("needle")
    if cap is not None:
        unfolded = unfolded.where(F.col("pos") < cap)
    return unfolded.select("hay_id", "needle", (F.sum("length").over(before) + wide).cast("long").alias("off"))
