"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed byte n-grams. Each language's training vectors are clustered into
a few centroids; a text takes the language of the centroid with the largest cosine. A text farther from every
centroid than training texts of its length ever are (times a margin) is rejected.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0 and rejected. Without labelled
rows every other text is ``und`` as well and none of these is rejected. Texts equal in their words get equal results.
Columns besides doc_id, text and lang are not read.

The classifier is fitted on about ``PER_LANGUAGE`` labelled rows of each language, chosen by a hash of the id; the
vectors of these rows, at most ``DIMENSIONS`` numbers each, are what reaches the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.batches import map_batches
from pulsegrid.llm.common import crc_bucket, documents

PER_LANGUAGE = 800
CENTROIDS = 4
DIMENSIONS = 1 << 12
ORDERS = (1, 2, 3)
ROUNDS = 12
#: A text is rejected below this share of the lowest cosine that training texts of its length have.
MARGIN = 0.5
#: Band b holds texts of 2^(b-1) to 2^b - 1 n-grams; below JUDGED_BAND a text is too short to be called foreign.
LENGTH_BANDS = 16
JUDGED_BAND = 7
UNKNOWN = "und"

_LETTERS_ONLY = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SPACES = re.compile(rb" +")


def has_letter(text: str) -> bool:
    """Number signs, like fractions and numerals of one character, are no letters."""
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of letters; words are set off by one space."""
    letters = _SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY) + b" ")
    data = np.frombuffer(letters, dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    gram = data
    for n in ORDERS:
        if n > 1:
            if len(gram) < 2:
                break
            gram = (gram[:-1] << np.uint32(8)) | data[n - 1:]
        mixed = (gram + np.uint32(n)) * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
    return counts


def unit(vector: np.ndarray) -> np.ndarray:
    return vector / max(float(np.sqrt(vector @ vector)), 1e-12)


def length_band(counts: np.ndarray) -> int:
    return min(int(counts.sum()).bit_length(), LENGTH_BANDS - 1)


@dataclass
class Centroids:
    idf: np.ndarray
    matrix: np.ndarray
    languages: list[str]
    floors: np.ndarray  # lowest training cosine by length band

    def plain(self) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """What executors get: arrays, which need no class of this package to be read."""
        return self.idf, self.matrix, self.languages, self.floors

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not has_letter(text):
            return UNKNOWN, 0.0, True
        if not self.languages:
            return UNKNOWN, 0.0, False
        counts = gram_counts(text)
        cosines = self.matrix @ unit(np.log1p(counts) * self.idf)
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[best], score, score < MARGIN * float(self.floors[length_band(counts)])


def cluster(vectors: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(count, len(vectors))).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        centres = np.stack([unit(vectors[nearest == k].sum(axis=0)) if (nearest == k).any() else centres[k] for k in range(len(centres))])
    return np.unique(centres, axis=0)


def training_rows(docs: DataFrame, eligible: Column, per_language: int) -> DataFrame:
    """(doc_id, text, lang) of about ``per_language`` eligible rows of each language."""
    known = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One number per language reaches the driver, so that no text is shuffled to be chosen.
    totals = {r.lang: r.rows for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}
    share = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    if not totals:
        return known.select("doc_id", "text", "lang")
    rates = F.create_map(*[F.lit(x) for lang, rows in sorted(totals.items()) for x in (lang, per_language / rows)])
    return known.where(share < rates[F.col("lang")]).select("doc_id", "text", "lang")


def fit(docs: DataFrame, eligible: Column, per_language: int = PER_LANGUAGE) -> Centroids:
    def vectors(batch):
        keep = [(lang, gram_counts(text)) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()) if has_letter(text)]
        cells = [np.flatnonzero(c) for _, c in keep]
        return {"lang": [lang for lang, _ in keep], "cells": [c.astype(np.int32).tobytes() for c in cells],
                "counts": [c[at].astype(np.int32).tobytes() for (_, c), at in zip(keep, cells)]}

    sample = training_rows(docs, eligible, per_language)
    rows = map_batches(sample.select("lang", "text"), vectors, "lang string, cells binary, counts binary").collect()
    rows.sort(key=lambda r: (r.lang, r.cells, r.counts))
    counts = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r.cells, dtype=np.int32)] = np.frombuffer(r.counts, dtype=np.int32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 0.1
    bands = np.array([length_band(c) for c in counts], dtype=int)
    counts = np.log1p(counts) * idf.astype(np.float32)
    counts /= np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-12)
    names = np.array([r.lang for r in rows], dtype=object)
    matrix, languages = [np.zeros((0, DIMENSIONS), dtype=np.float32)], []
    floors = np.full(LENGTH_BANDS, np.inf)
    for lang in sorted(set(names)):
        own = counts[names == lang]
        centres = cluster(own, CENTROIDS)
        matrix.append(centres.astype(np.float32))
        languages += [str(lang)] * len(centres)
        np.minimum.at(floors, bands[names == lang], (own @ centres.T).max(axis=1))
    # Shorter texts lie farther out: a band's floor is never above that of longer texts, nor of one without rows.
    floors = np.minimum.accumulate(floors[::-1])[::-1]
    floors[np.isinf(floors)] = 0.0
    floors[:JUDGED_BAND] = 0.0
    return Centroids(idf.astype(np.float32), np.concatenate(matrix), languages, floors)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def each(batch):
        own = Centroids(*shared.value)
        found = [own.predict(t) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, lang_pred string, score double, rejected boolean")


def rejects(spark: SparkSession, model: Centroids):
    """A function of a text column: whether the model rejects the text."""
    shared = spark.sparkContext.broadcast(model.plain())

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        own = Centroids(*shared.value)
        return pd.Series([own.predict(t)[2] for t in texts], dtype=bool)

    return rejected


def held_out() -> Column:
    return crc_bucket("doc_id", 4) == 2


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    found = predict(docs, fit(docs, F.coalesce(~held_out(), F.lit(True))))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
