"""Haystacks from files, needles from the binary token protocol, and the sinks.

A token request is a little-endian 32-bit count, then for each token its 32-bit length and its bytes.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest token of a presence request.
HAS_LIMIT = 4096


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes): a row a file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(hay_id, text) with one character a byte, so that string functions are exact over bytes."""
    return read_files(spark, path).select(F.xxhash64("path").alias("hay_id"), F.decode("bytes", "ISO-8859-1").alias("text"))


def decode_tokens(request: bytes, limit: int | None = None) -> list[bytes]:
    """The tokens of a request; ValueError where it ends early or a token exceeds the limit."""
    try:
        (n,) = struct.unpack_from("<I", request, 0)
        at, out = 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", request, at)
            if limit is not None and size > limit:
                raise ValueError(f"a token of {size} bytes; the limit is {limit}")
            if at + 4 + size > len(request):
                raise ValueError("the request ends early")
            out.append(request[at + 4 : at + 4 + size])
            at += 4 + size
    except struct.error as error:
        raise ValueError("the request ends early") from error
    return out


def encode_tokens(tokens: list[bytes]) -> bytes:
    return struct.pack("<I", len(tokens)) + b"".join(struct.pack("<I", len(t)) + t for t in tokens)


def presence_bytes(bits: list[bool]) -> bytes:
    """A byte 0 or 1 a token."""
    return bytes(map(int, bits))


def count_words(counts: list[int]) -> bytes:
    """A little-endian 32-bit count a token; larger ones wrap."""
    return b"".join(struct.pack("<I", n & 0xFFFFFFFF) for n in counts)


def repeats_lines(repeats: DataFrame) -> DataFrame:
    """(line): est_lin, count, length and the substring in base64, by tabs."""
    return repeats.select(F.concat_ws("\t", "est_lin", "n", "len", F.regexp_replace(F.base64("sub"), "\r\n", "")).alias("line"))
