"""Language identification: the nearest of several centroids a language, over TF-IDF of hashed n-grams.

A text is lower-cased and everything but letters becomes one space; its byte 1- to 4-grams are hashed
to ``DIM`` places, weighed 1 + log(tf) times the idf, and brought to length one.  The idf counts all
training documents.  Centroids are fitted on a bounded sample of them (``SAMPLE`` rows in all, dealt
evenly over the languages, the smallest hashes of doc_id first in expectation): spherical k-means
inside each language.  A text gets the language of the centroid with the largest cosine.

Rejection: a text farther from its centroid than all but ``REJECT`` of its language's training sample
is marked ``rejected``; its prediction stays the nearest language, as the contract wants a learned one.

Defined results: null text, or one without a letter, is ``und`` with score 0; very long texts are counted whole,
in runs of ``BLOCK`` bytes; rows with a null key or language are not learned from; with nothing to learn from every text is ``und``; repeated rows are
predicted one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.common import only
from needlework.plans.layout import spread

DIM = 2048
ORDERS = (1, 2, 3, 4)
CENTROIDS = 4
#: Rows of the labelled sample that the centroids are fitted on.
SAMPLE = 4000
REJECT = 0.001
ROUNDS = 10
#: Bytes of a text counted together.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _not_letters():
    import regex

    return regex.compile(r"\P{L}+"), regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _not_letters()[1].search(text) is not None


def counts(text: str) -> np.ndarray:
    """How often each of the DIM places is hit by the text's n-grams."""
    raw = np.frombuffer((" " + _not_letters()[0].sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(DIM, np.int64)
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK + max(ORDERS) - 1].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if n > len(part):
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            total += np.bincount((mixed >> np.uint32(21))[: min(BLOCK, len(raw) - at)], minlength=DIM)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    c = counts(text)
    v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


class Model:
    """Languages, the centroids' rows, and for each language the cosine below which a text is rejected."""

    def __init__(self, idf: np.ndarray, labels: list[str], centres: np.ndarray, floor: dict[str, float]):
        self.idf, self.labels, self.centres, self.floor = idf, labels, centres, floor

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine of the nearest centroid, rejected)."""
        if not self.labels or not has_letter(text):
            return "und", 0.0, True
        cosine = self.centres @ vector(text, self.idf)
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.labels[best], score, score < self.floor[self.labels[best]]


def _clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; seeds are the rows farthest from those chosen before."""
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centres.T, axis=1)
        new = np.stack([rows[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, centres):
            break
        centres = new
    return centres.astype(np.float32)


def _document_counts(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each place occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                total += counts(text.as_py() or "") > 0
                n += 1
        yield pa.record_batch([pa.array([*range(DIM), DIM]), pa.array([*total.tolist(), n])], names=["place", "n"])

    found = dict(train.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect())  # DIM + 1 rows
    return np.array([found.get(i, 0) for i in range(DIM)], np.float64), int(found.get(DIM, 0))


def fit(train: DataFrame, key: str = "doc_id") -> Model:
    """A model of (key, text, lang); null keys, texts and languages are left out."""
    rows = spread(only(train, **{key: "long", "text": "string", "lang": "string"})).where(f"{key} is not null and text is not null and lang is not null")
    df, n = _document_counts(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    per = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = per.count()
    if not languages:
        return Model(idf, [], np.zeros((0, DIM), np.float32), {})
    share = (SAMPLE / languages) / F.col("n")
    draw = F.pmod(F.xxhash64(F.lit("language sample"), key), F.lit(1_000_000)) / 1_000_000
    # a row a language: few enough to send, or else dealt out like the rows
    sample = rows.join(F.broadcast(per) if languages <= SAMPLE else per, "lang").where(draw < share).select("lang", "text", F.xxhash64(F.lit("order"), key, "text").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r["lang"], vector(r["text"], idf).tobytes(), r["place"]) for r in batch.to_pylist() if has_letter(r["text"])]
            yield pa.record_batch([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "v", "place"])

    # a bounded sample of labelled rows, the same in every run: more than SAMPLE only where keys repeat
    drawn = sample.mapInArrow(run, "lang string, v binary, place long").orderBy("place", "lang", "v").limit(2 * SAMPLE).collect()
    labels, centres, floor = [], [], {}
    by_language: dict[str, list] = {}
    for lang, v in sorted((r["lang"], bytes(r["v"])) for r in drawn):
        by_language.setdefault(lang, []).append(np.frombuffer(v, np.float32))
    for lang, vs in by_language.items():
        own = np.stack(vs)
        found = _clusters(own, CENTROIDS)
        labels += [lang] * len(found)
        centres.append(found)
        floor[lang] = float(np.quantile((own @ found.T).max(axis=1), REJECT))
    return Model(idf, labels, np.concatenate(centres) if centres else np.zeros((0, DIM), np.float32), floor)


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, rejected) of every whole text."""
    rows = spread(only(docs, **{key: "long", "text": "string"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)] if found else []
            if columns:
                yield pa.record_batch([batch.column(0), *columns], names=[key, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"{key} long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Learn from three folds of four by crc32 of the key as text, and predict every document."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held_out), key)
    return predict(docs, model, key).select(key, held_out.alias("held_out"), "lang_pred", "score", "rejected")
