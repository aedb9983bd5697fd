"""Toxicity scores from a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams of a document's distinct words, each counted once a document.
The fitting sample's document frequencies give every bucket its log-count ratio between toxic and
clean documents; the buckets with the strongest evidence are kept, scaled by that ratio, and
weighted by a regularised logistic regression trained in numpy.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import Shared, held_out, lean, small_slices

WORD = re.compile(r"\w+")
ORDERS = (2, 3, 4, 5, 6)
BUCKETS = 1 << 20
CACHE_WORDS = 200_000
SAME_ID = 4
LONG_WORD = 64  # longer words are not kept


@dataclass
class Scorer:
    """weight[bucket]: regression weight times log-count ratio; ``known`` marks the kept buckets."""

    known: frozenset
    weight: dict
    bias: float


def gram_ids(word: str) -> list[int]:
    """Hashed n-grams of one word between boundary marks."""
    raw = b"^" + word.encode("utf-8", "replace") + b"$"
    return [zlib.crc32(raw[k : k + n]) % BUCKETS for n in ORDERS for k in range(len(raw) - n + 1)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def document_counts(sample: DataFrame) -> np.ndarray:
    """``sample(text, toxic)`` -> document frequencies ``[toxic, bucket]``; each task returns one pair of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        cache: dict[str, np.ndarray] = {}
        for batch in small_slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                parts = []
                for w in words_of(text):
                    if (ids := cache.get(w)) is None:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        ids = np.array(gram_ids(w), np.int32)
                        if len(w) <= LONG_WORD:
                            cache[w] = ids
                    parts.append(ids)
                if parts:
                    counts[toxic, np.unique(np.concatenate(parts))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        for s in range(0, len(at), 100_000):
            own = at[s : s + 100_000]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "clean": pa.array(counts[0, own], pa.int64()), "toxic": pa.array(counts[1, own], pa.int64())})

    rows = sample.mapInArrow(lean(run), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = rows.where("clean + toxic >= 3").toArrow()
    out = np.zeros((2, BUCKETS))
    for k, name in enumerate(("clean", "toxic")):
        out[k, found.column("bucket").to_numpy()] = found.column(name).to_numpy()
    return out


def log_ratios(counts: np.ndarray, keep: int, evidence: float = 10.0) -> dict[int, float]:
    """Naive Bayes log-count ratios of the ``keep`` buckets with the largest likelihood-ratio evidence."""
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    share = counts[1].sum() / max(counts.sum(), 1)
    total = counts.sum(axis=0)
    expected = np.maximum(total * share, 1e-9)
    strength = (counts[1] - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    order = np.lexsort((np.arange(len(total)), -strength))[:keep]
    return {int(b): float(ratio[b]) for b in order if strength[b] >= evidence}


def train(rows: list[tuple[int, list[int]]], ratios: dict[int, float], penalty: float = 1e-3, steps: int = 300) -> Scorer:
    """Logistic regression on the presence of the kept buckets, each scaled by its log-count ratio."""
    names = sorted(ratios)
    place = {b: k for k, b in enumerate(names)}
    scale = np.array([ratios[b] for b in names])
    y = np.array([label for label, _ in rows], dtype=float)
    sizes = np.array([len(ids) for _, ids in rows])
    doc, col = np.repeat(np.arange(len(rows)), sizes), np.array([place[b] for _, ids in rows for b in ids], dtype=np.int64)
    value = scale[col] if len(col) else np.zeros(0)
    w, bias = np.zeros(len(names)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    a, b, a0, b0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for step in range(1, steps + 1):
        z = bias + np.bincount(doc, w[col] * value, len(rows))
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        gw, g0 = np.bincount(col, g[doc] * value, len(names)) + penalty * w / len(names), g.sum()
        a, b = 0.9 * a + 0.1 * gw, 0.99 * b + 0.01 * gw * gw
        a0, b0 = 0.9 * a0 + 0.1 * g0, 0.99 * b0 + 0.01 * g0 * g0
        w -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
        bias -= 0.05 * (a0 / (1 - 0.9**step)) / (np.sqrt(b0 / (1 - 0.99**step)) + 1e-9)
    return Scorer(frozenset(names), {n: float(x * s) for n, x, s in zip(names, w, scale, strict=True)}, float(bias))


def _features(batches: Iterator[pa.RecordBatch], known: frozenset) -> Iterator[tuple[pa.RecordBatch, list[set[int]]]]:
    """Kept buckets present in each text; words are hashed once per task while the cache holds them."""
    cache: dict[str, tuple] = {}
    for batch in small_slices(batches, "text"):
        out = []
        for text in batch.column("text").to_pylist():
            present: set[int] = set()
            for w in words_of(text):
                if (ids := cache.get(w)) is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    ids = tuple(known.intersection(gram_ids(w)))
                    if len(w) <= LONG_WORD:
                        cache[w] = ids
                if ids:
                    present.update(ids)
            out.append(present)
        yield batch, out


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = 6000, keep: int = 4096) -> Scorer | None:
    """Fit on about ``fit_docs`` labelled documents outside the held-out fifth; None if no labelled text is there.

    Labels other than 0 and 1 are left out; an id with both counts as toxic. Of the rows of ``docs`` with the id the ``SAME_ID`` with the
    smallest hashes of their texts are learned from, null texts left out. Extra columns of either table are ignored.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isin(0, 1) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = usable.count()
    part = int(min(1.0, fit_docs / max(total, 1)) * (1 << 30))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) < part).orderBy("doc_id").limit(2 * fit_docs)
    rows = [tuple(r) for r in chosen.collect()]
    if not rows:
        return None
    bounded = F.broadcast(spark.createDataFrame(rows, "doc_id long, toxic int"))  # at most 2 * fit_docs rows
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(bounded, "doc_id").select("doc_id", "text", "toxic")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    sample = rows.withColumn("place", place).where(F.col("place") <= SAME_ID).drop("place")
    ratios = log_ratios(document_counts(sample), keep)
    known = Shared(spark, frozenset(ratios))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _features(batches, known.value):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([sorted(f) for f in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "ids"])

    table = sorted((r.doc_id, r.toxic, list(r.ids)) for r in sample.mapInArrow(lean(run), "doc_id long, toxic int, ids array<long>").collect())
    return train([(toxic, ids) for _, toxic, ids in table], ratios) if table else None


def _scores(found: list[set[int]], model: Scorer | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(found))
    z = np.array([model.bias + sum(model.weight[b] for b in sorted(f)) for f in found])
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def predict(docs: DataFrame, model: Scorer | None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, score)``, one row per input row; null and empty texts get the model's base score.

    Without any label to learn from every score is 0. Extra columns are ignored.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, found in _features(batches, model.known if model else frozenset()):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(found, model))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Scorer | None, below: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, scored under ``below``; null and empty texts have the base score, repeated rows are judged alike."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, found in _features(batches, model.known if model else frozenset()):
            yield batch.filter(pa.array(_scores(found, model) < below))

    return docs.mapInArrow(lean(run), docs.schema)
