"""Quality by importance resampling: target and raw generative models over hashed n-grams.

Two generative models over the same hashed places give each document an importance weight, the likelihood
of its n-grams under the target text over that under the raw text; the log weight is a sum over all of its
n-grams.  The raw model counts the n-grams of all documents; the target model those of documents labelled
good, a bounded sample (``SAMPLE`` labels, a documented parameter).  Features come in two families, words with
word pairs, and byte 3-grams by the class of their characters.

Resampling without replacement is Gumbel top-k: to the log weight comes Gumbel noise of unit scale, drawn from a
hash of the document, and the k largest stay.  k is the number of documents that the raw model makes at most
exp(``MARGIN``) times likelier than the target model does.  The k-th largest is found exactly by radix selection
over bounded histograms, not by sorting.

Defined results: null and empty texts have no n-grams, log weight 0 and no evidence against them: they
take part like others; very long texts are taken whole, in runs of ``BLOCK``; without good labels everything
stays; ties with the k-th stay, and repeated rows, scored one by one, draw the same noise; an empty table gives
an empty result; other columns are kept by ``keep`` only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needlework.llm.common import only, stage
from needlework.plans.layout import spread

PLACES = 1 << 14
SAMPLE = 20_000
#: Documents of a log weight of minus so much or more are counted into k.
MARGIN = 4.0
#: Words or bytes of a text counted together.
BLOCK = 1 << 19

_CLASS = np.zeros(256, np.uint32)
for _c in range(256):
    _CLASS[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c >= 128 else 5 if _c in (32, 10) else _c


def counts(text: str | None) -> np.ndarray:
    """How often each of 2 * PLACES places is hit: words and pairs first, then bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    total = np.zeros(2 * PLACES, np.int64)
    words = raw.split()
    last = np.zeros(0, np.uint32)
    crc = zlib.crc32
    for at in range(0, len(words), BLOCK):
        h = np.array([crc(w) for w in words[at : at + BLOCK]], np.uint32)
        total[:PLACES] += np.bincount(h & np.uint32(PLACES - 1), minlength=PLACES)
        chain = np.concatenate([last, h])
        pairs = (chain[:-1] * np.uint32(0x9E3779B1)) ^ chain[1:] * np.uint32(0x85EBCA6B)
        total[:PLACES] += np.bincount((pairs >> np.uint32(7)) & np.uint32(PLACES - 1), minlength=PLACES)
        last = h[-1:]
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data), BLOCK):
        part = _CLASS[data[at : at + BLOCK + 2]]
        if len(part) >= 3:
            h = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA6B)) ^ (part[2:] * np.uint32(0xC2B2AE35))
            total[PLACES:] += np.bincount((h >> np.uint32(11)) & np.uint32(PLACES - 1), minlength=PLACES)
    return total


def models(docs: DataFrame, good: DataFrame, key: str = "doc_id") -> np.ndarray | None:
    """log p(target) - log p(raw) of every place; None without good labels."""
    rows = spread(only(docs, **{key: "long", "text": "string"}))
    labelled = good.select(F.col(key).alias("__good")).distinct().orderBy(F.xxhash64(F.lit("importance"), "__good")).limit(SAMPLE)
    # at most SAMPLE keys
    marked = rows.join(F.broadcast(labelled), F.col(key) == F.col("__good"), "left").select("text", F.col("__good").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * PLACES, np.int64), np.zeros(2 * PLACES, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = counts(text.as_py())
                raw += found
                if is_good:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["place", "raw", "target"])

    sums = marked.mapInArrow(run, "place long, raw long, target long").groupBy("place").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(2 * PLACES), np.zeros(2 * PLACES)
    for place, r, t in sums.collect():  # a row a place
        raw[place], target[place] = r, t
    if not target.sum():
        return None
    out = np.zeros(2 * PLACES, np.float64)
    for own in (slice(0, PLACES), slice(PLACES, None)):
        # shrunk towards the raw model, so that a place the sample hardly meets says little
        p = raw[own] / max(1.0, raw[own].sum())
        q = (target[own] + PLACES * p) / (target[own].sum() + PLACES)
        out[own] = np.where(raw[own] > 0, np.log(np.maximum(q, 1e-12)) - np.log(np.maximum(p, 1e-12)), 0.0)
    return out


def log_weights(docs: DataFrame, model: np.ndarray | None, key: str = "doc_id", carry: bool = False) -> DataFrame:
    """(key, score), or all columns and __score: the log importance weight of every document."""
    rows = spread(only(docs, **{key: "long", "text": "string"}))

    def score(text: str | None) -> float:
        if model is None:
            return 0.0
        return float((counts(text) * model).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield batch.append_column("__score", scores) if carry else pa.record_batch([batch.column(key), scores], names=[key, "score"])

    if carry:
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))
    return rows.mapInArrow(run, f"{key} long, score double")


def _noisy(score: Column, *identity: str) -> Column:
    """Log weight plus Gumbel noise, in fixed point, so that every engine orders it alike."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *identity), 12) + 0.5) * F.lit(2.0**-52)
    return F.floor((score - F.log(-F.log(u))) * 2**20).cast("long")


def _kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``value``, by histograms of 16 bits at a time."""
    shifted = F.col("value").bitwiseXOR(F.lit(-(2**63)))  # unsigned order
    low, picked = 0, None
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned(shifted, shift)
        own = values if picked is None else values.where(F.shiftrightunsigned(shifted, shift + 16) == F.lit(_signed(picked)))
        histogram = own.groupBy(part.bitwiseAND(F.lit(0xFFFF)).alias("digit")).count().orderBy(F.desc("digit")).collect()  # at most 65,536 rows
        for digit, n in histogram:
            if n >= k:
                low = digit
                break
            k -= n
        else:
            return None
        picked = low if picked is None else picked << 16 | low
    return _signed(picked ^ 2**63)


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def least_taken(valued: DataFrame, score: str = "score") -> int | None:
    """The k-th largest ``value`` of (score, value): the least that stays; None of nothing."""
    k = valued.where(F.col(score) >= -MARGIN).count()
    return _kth_largest(valued, k) if k else None


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, score, kept) of every document."""
    model = models(docs, _good(labels, key), key)
    scored = log_weights(docs, model, key)
    valued = stage(scored.select(key, "score", _noisy(F.col("score"), key).alias("value")), "importance")
    least = least_taken(valued)
    kept = F.lit(model is None) if least is None else F.col("value") >= least
    return valued.select(key, "score", (F.lit(True) if model is None else kept).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents, all their columns, that the resampling takes; scored rows are staged whole, so texts are scored once."""
    model = models(docs, _good(labels, key), key)
    if model is None:
        return docs
    rows = log_weights(docs, model, key, carry=True)
    valued = stage(rows.withColumn("__value", _noisy(F.col("__score"), key)), "importance")
    least = least_taken(valued.select("__score", F.col("__value").alias("value")), "__score")
    kept = valued.where("1 = 0") if least is None else valued.where(F.col("__value") >= least)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _good(labels: DataFrame, key: str) -> DataFrame:
    return only(labels, **{key: "long", "quality": "int"}).where("quality = 1").select(key)
