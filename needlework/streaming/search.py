"""The same searches over streams: stateless ones unchanged, content dedup inside a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.functions import search


def matches(stream: DataFrame, needles: list[str], text: str = "text") -> DataFrame:
    """Rows of the stream once for each stated needle that occurs, with its first offset and count."""
    rows = stream.withColumn("needle", F.explode(F.array(*map(F.lit, needles)))).where(F.contains(text, "needle"))
    return rows.withColumns({"off": search.find(text, F.col("needle")), "n": search.count(text, F.col("needle"))})


def first_contents(stream: DataFrame, time: str, delay: str, text: str = "text") -> DataFrame:
    """The first row of each content inside the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([text])


def hits_by_window(stream: DataFrame, needles: list[str], time: str, delay: str, width: str, text: str = "text") -> DataFrame:
    """(window, needle, hits, n): matches by event-time window."""
    found = matches(stream.withWatermark(time, delay), needles, text)
    return found.groupBy(F.window(time, width), "needle").agg(F.count("*").alias("hits"), F.sum("n").alias("n"))
