"""Language ID by nearest centroids: TF-IDF vectors of letter n-grams, several clusters a language, cosine, rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices

#: Hashed dimensions of a vector; n-grams have 1 to GRAMS letters or word ends.
DIMS, GRAMS = 4096, 3
#: Clusters a language, and the about so many documents of it (by least hash of their ids) that the clusters are fitted on.
CLUSTERS, FIT_PER_LANGUAGE = 4, 500
#: A text is rejected if its best cosine is under this part of what one in a hundred texts of the language falls below.
REJECT = 0.5
#: Text bytes, and texts, turned into n-grams at a time. A text's counts take 16 KB however short it is.
STEP_BYTES, STEP_ROWS = 1 << 20, 512
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has the n-grams of each dimension, and its letters."""
    text = "\x00".join(x.lower().replace("\x00", " ") for x in texts) + "\x00"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = codes == 0
    doc = np.cumsum(ends) - ends
    letter = _letters()[codes]
    kept = letter | np.r_[False, letter[:-1]] | ends
    code, doc = np.where(letter, codes, 1).astype(np.uint64)[kept], doc[kept]
    out = np.zeros(len(texts) * DIMS, np.int32)
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, min(GRAMS, len(code)) + 1):
        gram = gram * np.uint64(0x110000) + np.roll(code, 1 - n)
        valid = np.ones(len(code), bool) if n == 1 else np.r_[doc[n - 1 :] == doc[: 1 - n], np.zeros(n - 1, bool)]
        valid &= code != 1 if n == 1 else valid
        mixed = (gram[valid] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        out += np.bincount(doc[valid] * DIMS + mixed.astype(np.int64), minlength=len(out)).astype(np.int32)
    return out.reshape(len(texts), DIMS), np.bincount(doc, weights=code != 1, minlength=len(texts)).astype(np.int64)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of length 1 (0 without n-grams)."""
    out = np.log1p(found.astype(np.float32)) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def clusters(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: the first centre is nearest the mean, each next one farthest from those before."""
    centres = [points[np.argmax(points @ points.mean(axis=0))]]
    while len(centres) < min(k, len(points)):
        centres.append(points[np.argmin(np.max(points @ np.array(centres).T, axis=1))])
    made = np.array(centres)
    for _ in range(rounds):
        nearest = np.argmax(points @ made.T, axis=1)
        made = np.array([points[nearest == i].mean(axis=0) if (nearest == i).any() else made[i] for i in range(len(made))])
        made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    return made


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    floors: np.ndarray


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, text, STEP_BYTES, STEP_ROWS):
            yield part, *counts([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()])


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = FIT_PER_LANGUAGE, k: int = CLUSTERS) -> Model | None:
    """A model of `labelled`; rows without key, text or language are left out. None if no row is left.

    Document frequencies count all rows. Clusters are fitted on at most about `per_language` documents of each
    language, those with the least hashes of their keys; only dimensions and centroids reach the driver.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).alias("l")).where("k is not null and t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(DIMS, np.int64)
        for _, found, _ in _parts(batches, "t"):
            held += (found > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS)), pa.array(held)], names=["d", "n"])

    held = np.zeros(DIMS)
    for r in rows.select("t").mapInArrow(released(frequency), "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).collect():
        held[r["d"]] = r["n"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + held)) + 1).astype(np.float32)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("l") == name, min(1.0, per_language / n)).otherwise(share)
    chosen = rows.where((F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)) < share)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, letters in _parts(batches, "t"):
            made = vectors(found, idf)
            use = np.flatnonzero(letters)
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(use)), pa.array([made[i].tobytes() for i in use], pa.binary())], names=["l", "v"])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.stack([np.frombuffer(x, np.float32) for x in sorted(pdf["v"])])
        made = clusters(points, k).astype(np.float32)
        floor = float(np.quantile(np.max(points @ made.T, axis=1), 0.01)) * REJECT
        return pd.DataFrame({"l": pdf["l"].iloc[0], "v": [x.tobytes() for x in made], "f": floor})

    made = sorted(chosen.select("t", "l").mapInArrow(released(vector), "l string, v binary").groupBy("l").applyInPandas(group, "l string, v binary, f double").collect(), key=lambda r: r["l"])
    if not made:
        return None
    names = sorted({r["l"] for r in made})
    at = {x: i for i, x in enumerate(names)}
    return Model(idf, names, np.stack([np.frombuffer(r["v"], np.float32) for r in made]), np.array([at[r["l"]] for r in made]), np.array([next(r["f"] for r in made if r["l"] == x) for x in names]))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (the best cosine, 0 to 1) and rejected, from whole texts.

    Without letters (or null), a text is `und` with score 0 and rejected; without a model all are. Ties go to the
    language first in order. Rows are independent; columns named like an output are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, letters in _parts(batches, text):
            n = len(letters)
            names, score, bad = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            if model is not None:
                near = vectors(found, model.idf) @ model.centroids.T
                best = np.stack([near[:, model.of == i].max(axis=1) for i in range(len(model.languages))], axis=1)
                which = best.argmax(axis=1)
                score = np.where(letters > 0, best.max(axis=1).clip(0, 1), 0).astype(np.float64)
                bad = (letters == 0) | (score < model.floors[which])
                names = [model.languages[w] if x else UNKNOWN for w, x in zip(which, letters)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(bad)], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(released(run), schema)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`."""
    return F.crc32(key.cast("string").cast("binary")) % by
