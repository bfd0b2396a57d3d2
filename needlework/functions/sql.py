"""The searches as SQL functions of a session, and the forms that scripting callers expect.

``register`` makes temporary SQL functions: their bodies are expressions, so Catalyst inlines them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.functions import search
from needlework.operators.repeats import Options, repeats

FUNCTIONS = {
    "needle_find": ("h STRING, n STRING", "BIGINT", "CAST(instr(h, n) - 1 AS BIGINT)"),
    "needle_find_bytes": ("h STRING, n STRING", "BIGINT", "CAST(CASE WHEN instr(h, n) = 0 THEN -1 ELSE octet_length(substring(h, 1, instr(h, n) - 1)) END AS BIGINT)"),
    "needle_has": ("h STRING, n STRING", "BOOLEAN", "contains(h, n)"),
    "needle_count": (
        "h STRING, n STRING", "BIGINT", "CASE WHEN n = '' THEN 0 ELSE CAST((length(h) - length(replace(h, n, ''))) DIV greatest(length(n), 1) AS BIGINT) END",
    ),
    "needle_position": ("h STRING, n STRING", "BIGINT", "CASE WHEN instr(h, n) > 0 THEN CAST(instr(h, n) - 1 AS BIGINT) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for name, (given, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


def position(hay: Column | str, needle: Column | str) -> Column:
    """The leftmost offset, null where the needle is absent."""
    at = search.find(hay, needle)
    return F.when(at >= 0, at)


def positions(hay: Column | str, needle: Column | str, overlap: bool = False, cap: int = 65_536) -> Column:
    """Offsets as scripting callers expect: the empty needle is at 0; cap is held within 1 and 1,048,576."""
    needle = needle if isinstance(needle, Column) else F.lit(needle)
    found = search.find_all(hay, needle, overlap, max(1, min(cap, 1 << 20)))
    return F.when(needle == "", F.array(F.lit(0).cast("long"))).otherwise(found)


def repeats_map(hays: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(hay_id, repeats): a map from substring to count; null for haystacks under 64 bytes or without repeats."""
    held = Options(options.min_len, options.max_len, max(2, options.min_count), max(1, min(64, options.top_k)), options.base)
    found = repeats(hays.where(F.octet_length("text") >= 64), held).groupBy("hay_id").agg(F.map_from_entries(F.collect_list(F.struct(F.hex("sub"), "n"))).alias("repeats"))
    return hays.select("hay_id").join(found, "hay_id", "left")
