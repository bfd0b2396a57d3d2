"""Command line: find, count, count-batch, has and repeats over one file, through the DataFrame API."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from needlework.functions import search
from needlework.operators import batch
from needlework.operators.repeats import Options, repeats
from needlework.sources import files


def main(argv: list[str] | None = None, spark: SparkSession | None = None, request: bytes | None = None, out=None) -> int:
    parser = argparse.ArgumentParser(prog="needlework")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("find", "count"):
        one = commands.add_parser(name)
        one.add_argument("file")
        one.add_argument("needle")
        if name == "count":
            one.add_argument("overlap", nargs="?", default="0")
    for name in ("has", "count-batch"):
        commands.add_parser(name, help="tokens come from standard input").add_argument("file")
    many = commands.add_parser("repeats")
    many.add_argument("file")
    for name, value in (("min_len", 4), ("max_len", 128), ("top_k", 16)):
        many.add_argument(name, nargs="?", type=int, default=value)
    given = list(sys.argv[1:] if argv is None else argv)
    if len(given) == 1 and given[0] not in commands.choices and not given[0].startswith("-"):
        given.insert(0, "has")
    args = parser.parse_args(given)
    spark = spark or SparkSession.builder.appName("needlework").getOrCreate()
    out = out or sys.stdout.buffer
    texts = files.read_texts(spark, args.file)
    latin = lambda b: b.decode("latin-1")
    if args.command in ("find", "count"):
        needle = latin(args.needle.encode())
        value = search.find("text", needle) if args.command == "find" else search.count("text", needle, args.overlap.startswith("1"))
        out.write(f"{texts.select(value).first()[0]}\n".encode())
    elif args.command in ("has", "count-batch"):
        request = sys.stdin.buffer.read() if request is None else request
        tokens = [latin(t) for t in files.decode_tokens(request, files.HAS_LIMIT if args.command == "has" else None)]
        rows = spark.createDataFrame([(t,) for t in tokens], "needle string")
        counts = {r["needle"]: r["n"] for r in batch.count_pairs(texts, rows, strategy="scan").collect()}  # a row a token
        if args.command == "has":
            out.write(files.presence_bytes([t == "" or t in counts for t in tokens]))
        else:
            out.write(files.count_words([counts.get(t, 0) for t in tokens]))
    else:
        raw = files.read_files(spark, args.file).select(F.lit(0).alias("hay_id"), F.col("bytes").alias("text"))  # bytes as they are
        found = repeats(raw, Options(args.min_len, args.max_len, 2, min(64, args.top_k)))
        for (line,) in files.repeats_lines(found.orderBy("est_lin", F.desc("len"), F.desc("n"), "sub")).collect():  # at most 64 rows
            out.write(f"{line}\n".encode())
    return 0


if __name__ == "__main__":
    sys.exit(main())
