"""Document fingerprints by consistent weighted sampling.

Each of SAMPLES draws picks one weighted term of a text so that two texts pick the same with the probability of their
generalised Jaccard similarity, sum of lesser weights over sum of greater ones. For term k and draw i, r and c are
gamma(2, 1) and beta is uniform, all from hashes of k and i; then t = floor(ln w / r + beta), ln y = r (t - beta), and the
term with the least ln a = ln c - ln y - r is drawn. ln a is a function of (i, k, t) alone, so its bits stand for the draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import coded, hashes, mixed, slices, words

SAMPLES = 64
#: (term, weight) pairs whose draws are made at once; with SAMPLES doubles each, 8 MB.
CHUNK = 1 << 14
_DRAWS = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _uniform(keys: np.ndarray, of: int) -> np.ndarray:
    """In (0, 1], for each key and draw."""
    return ((mixed(keys[:, None] + _DRAWS[None, :] * np.uint64(2 * of + 1)) >> np.uint64(40)).astype(np.float32) + np.float32(1)) * np.float32(2.0**-24)


def draws(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ln a of each (term hash, weight) and draw."""
    r = np.maximum(-np.log(_uniform(keys, 0) * _uniform(keys, 1)), np.float32(1e-6))
    c = np.log(-np.log(_uniform(keys, 2) * _uniform(keys, 3)))
    beta = _uniform(keys, 4)
    steps = np.log(weights.astype(np.float32))[:, None] / r + beta
    return c - r * (np.floor(steps) - beta) - r


def signatures(texts: list[str]) -> np.ndarray:
    """SAMPLES 32-bit draws of each text: its lower-cased words, weighted by how often they occur. No words: all zero."""
    counts, flat = words(pa.array(texts, pa.large_string()))
    codes, distinct = coded(flat)
    out = np.zeros((len(texts), SAMPLES), np.uint32)
    if not len(codes):
        return out
    doc = np.repeat(np.arange(len(texts)), counts)
    pair, weight = np.unique(doc * np.int64(len(distinct)) + codes, return_counts=True)
    doc, code = pair // len(distinct), pair % len(distinct)
    most = int(weight.max()) + 1
    term, of = np.unique(code * most + weight, return_inverse=True)
    keys, weights = hashes(distinct)[term // most], term % most
    least = np.full((len(texts), SAMPLES), np.inf, np.float32)
    # Terms in chunks: a chunk's draws are made once, however many texts have the term.
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(0, len(term) + CHUNK, CHUNK))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if a == b:
            continue
        made = draws(keys[i * CHUNK : (i + 1) * CHUNK], weights[i * CHUNK : (i + 1) * CHUNK])
        rows = np.sort(order[a:b])
        for s in range(0, len(rows), CHUNK):
            some = rows[s : s + CHUNK]
            heads = np.flatnonzero(np.r_[True, np.diff(doc[some]) != 0])
            best = np.minimum.reduceat(made[of[some] - i * CHUNK], heads, axis=0)
            least[doc[some][heads]] = np.minimum(least[doc[some][heads]], best)
    full = counts > 0
    out[full] = least[full].view(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal draws, row by row."""
    return (a == b).mean(axis=1)


def as_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in signature]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `fingerprint`: the draws in hex. Null and empty texts have that of no words, which is like itself only.

    Rows are independent, so ties and repeated rows need no care. A column `fingerprint` is replaced.
    """
    docs = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = pa.array(as_text(signatures([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()])), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def edited(text: str, after: str) -> str:
    """`text` with its last half (rounded down) replaced by as many first characters of `after`, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", per_bucket: int = 2000) -> DataFrame:
    """Of each row: key, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The next row is the one before in descending order of key (nulls last, ties by text); after the last comes the first.
    Rows are dealt into ranges of keys between quantiles; a range also gets the first row of the range after it, so each
    task goes through whole ranges, sorted, and no task sees all rows. Null texts count as empty.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit((1 << 63) - 1))
    rows = docs.select(F.col(key).cast("long").alias("key"), order.cast("long").alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n = docs.count()
    if not n:
        return spark.createDataFrame([], schema)
    buckets = max(1, min(1 << 16, -(-n // per_bucket)))
    fences = sorted(set(rows.select(F.percentile_approx("_o", [i / buckets for i in range(1, buckets)] or [0.5], min(1_000_000, 100 * buckets))).first()[0]))
    fences = np.array(fences, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(fences, batch.column(1).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1), batch.column(2)], names=["bucket", "_o", "_h"])

    rows = rows.withColumn("_h", F.xxhash64("text"))
    # One row a range reaches the driver: at most 65,536 of 24 bytes.
    first = {r["bucket"]: (r["f"]["_o"], r["f"]["_h"]) for r in rows.select("key", "_o", "_h").mapInArrow(place, "bucket int, _o long, _h long").groupBy("bucket").agg(F.min(F.struct("_o", "_h")).alias("f")).collect()}
    full = sorted(first)
    before = {first[b]: full[i - 1] for i, b in enumerate(full)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, h = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            at = np.searchsorted(fences, o, side="right").astype(np.int32)
            heads = [(i, before[x]) for i, x in enumerate(zip(o.tolist(), h.tolist())) if x in before]
            extra = np.zeros(len(at), bool)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(extra), *batch.columns], names=["bucket", "extra", *batch.schema.names])
            if heads:
                some = batch.take(pa.array([i for i, _ in heads]))
                yield pa.RecordBatch.from_arrays([pa.array([b for _, b in heads], pa.int32()), pa.array([True] * len(heads)), *some.columns], names=["bucket", "extra", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        sign = np.zeros((0, SAMPLES), np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [*last, *zip(part["bucket"].to_pylist(), part["extra"].to_pylist(), part["key"].to_pylist(), part["text"].to_pylist())]
                sign = np.concatenate([sign, signatures([x[3] for x in rows[len(last) :]])])
                at = [i for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[0] == b[0] and not a[1]]
                new = [edited(rows[i][3], rows[i + 1][3]) for i in at]
                if at:
                    other, own = signatures(new), sign[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([rows[i][2] for i in at], pa.int64()),
                            pa.array([len(rows[i][3]) for i in at], pa.int64()),
                            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                            pa.array(as_text(own)),
                            pa.array(as_text(other)),
                            pa.array(likeness(own, other)),
                            pa.array(likeness(own, sign[[i + 1 for i in at]])),
                        ],
                        names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )
                last, sign = rows[-1:], sign[-1:]

    dealt = rows.mapInArrow(deal, "bucket int, extra boolean, key long, _o long, text string, _h long").repartition("bucket").sortWithinPartitions("bucket", "extra", "_o", "_h", "text")
    return dealt.mapInArrow(run, schema)
