"""Importance resampling: keep the documents that look most like target text.

Both models are bags of hashed words and word pairs. The raw model counts all documents, the target
model a bounded sample of labelled good ones. A document's weight is the mean log-ratio of its
features, times ``stretch``: it speaks of a stretch of that many features, whatever the document's
length. Gumbel noise from a hash of the row turns a top-k into sampling without replacement in
proportion to the weights, and reruns agree.

Defined cases. Null or empty text: weight 0. Null doc_id: scored like any other. Rows equal in all
columns: equal keys, ranks in any order. No labels: the target equals the raw model and all weights
are 0. Empty table: empty result. Other columns: part of the row's hash only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import map_batches, mix, named_slices, row_key, sampled, text_bytes, written
from orderloom.operators.ordering import running_totals

BUCKETS = 10_000
TARGET_DOCS = 20_000        # bound of the labelled sample
FRACTION = 0.8              # of all documents that is kept
STRETCH = 50
SMOOTHING = 1.0


def document_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Buckets of all words and word pairs of each whole text, with repeats."""
    for first, last, names, begins in named_slices(texts, fold_case=True):
        words = (names % np.uint64(BUCKETS)).astype(np.int64)
        pairs = mix(names[:-1] * np.uint64(0x9E3779B97F4A7C15) + names[1:]) if len(names) > 1 else names[:0]
        pairs = (pairs % np.uint64(BUCKETS)).astype(np.int64)
        for k in range(last - first):
            b, e = begins[k], begins[k + 1]
            yield np.concatenate([words[b:e], pairs[b : max(e - 1, b)]])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Feature counts of a column ``text`` (bytes): one row per bucket and task, summed, BUCKETS numbers to the driver."""

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in source:
            for found in document_features(batch.column(0)):
                total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for row in map_batches(texts, step, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p / q)


def weights(docs: DataFrame, ratio: np.ndarray, stretch: float = STRETCH) -> DataFrame:
    """doc_id, h, log_weight, gumbel_key of every row."""

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            w = np.array([stretch * ratio[f].mean() if len(f) else 0.0 for f in document_features(batch.column(2))])
            h = batch.column(1).to_numpy().view(np.uint64)
            u = ((mix(h + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(w), pa.array(w - np.log(-np.log(u)))],
                ["doc_id", "h", "log_weight", "gumbel_key"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("h"), text_bytes()), step,
                       "doc_id long, h long, log_weight double, gumbel_key double")


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, target_docs: int = TARGET_DOCS) -> DataFrame:
    """doc_id, log_weight, gumbel_key, place, kept: the best ``fraction`` of all rows by key is kept."""
    good = sampled(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct(),
                   F.xxhash64("_id"), target_docs)
    # At most ``target_docs`` ids, so the broadcast is bounded.
    target = docs.join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left_semi")
    ratio = log_ratio(bucket_counts(target.select(text_bytes())), bucket_counts(docs.select(text_bytes())))
    scored = written(weights(docs, ratio), "weights")
    ranked = running_totals(scored.withColumn("_one", F.lit(1)), [F.col("gumbel_key").desc(), F.col("h"), F.col("doc_id")],
                            {"_one": "place"})
    return ranked.select("doc_id", "log_weight", "gumbel_key", "place",
                         (F.col("place") <= F.floor(F.lit(fraction) * F.col("place_total"))).alias("kept"))
