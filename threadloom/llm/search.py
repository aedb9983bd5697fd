"""Ranked lexical search by the threshold algorithm, over a document-partitioned index.

The items are a stated query set, taken in blocks of bounded size: their vocabulary goes to the tasks. One scan
of the texts writes a forward index of the block's terms, from which document frequencies and mean lengths
follow. Then each task turns its part of that index into lists sorted by impact and reads an item's lists
round-robin, looking up every new document's whole score in the forward index, until the threshold (what a document not yet met can
score at most) falls strictly below the worst of the best documents. Those of all tasks are ranked in the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import Shared, lean, small_slices
from threadloom.session import drop_path, materialize

SCALE = 1_000_000_000
BLOCK_TERMS = 200_000
CHUNK_POSTINGS = 1_000_000
CHUNK_DOCS = 100_000
FIRST_DEPTH = 16

#: Bytes outside of terms become spaces, A-Z lower case; digits, letters and bytes beyond ASCII stay.
TO_TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_TERMS).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, dict[bytes, int]]]]:
    """Distinct rows of ``items(item_id, text)`` as (item_id, times of each term), some at a time; the driver holds one block."""
    block, held = [], 0
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).distinct().toLocalIterator():
        times = Counter(terms_of(row["text"]))
        if block and held + len(times) > BLOCK_TERMS:
            yield block
            block, held = [], 0
        if times:
            block.append((row["item_id"], times))
            held += len(times)
    if block:
        yield block


def forward_index(docs: DataFrame, vocabulary: Shared) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n, terms, times)`` of every text with a term; ``terms`` are ascending numbers of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in small_slices(batches, "text"):
            ids, sizes, terms, times = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    found = sorted(Counter(k for k in map(number, words) if k is not None).items())
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append([k for k, _ in found])
                    times.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, n long, terms array<int>, times array<long>")


def term_weights(docs_with: np.ndarray, n_docs: int) -> np.ndarray:
    """``floor(1000 * ln((2N + 2) / (2 df + 1)))`` per term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in docs_with.tolist()], np.int64)


class Index:
    """Forward index and impact-sorted lists of some documents, which are in the order of their ids, null last."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.width = len(weights)
        doc = np.repeat(np.arange(len(sizes)), counts)
        length = 75 + np.array([25 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)
        self.keys = doc * self.width + terms
        self.impacts = weights[terms] * ((SCALE * times) // (1000 * times + 12 * length[doc]))
        order = np.lexsort((doc, -self.impacts, terms))
        self.list_docs, self.list_impacts = doc[order], self.impacts[order]
        self.bounds = np.searchsorted(terms[order], np.arange(self.width + 1))
        self.stamps = np.full(len(sizes), -1)

    def scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs`` by looking their terms up in the forward index."""
        wanted = docs[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (np.where(self.keys[at] == wanted, self.impacts[at], 0) * times[None, :]).sum(axis=1)

    def best(self, stamp: int, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """``(docs, scores)`` of the ``k`` best documents of an item, equal scores in document order.

        The lists are read side by side, some entries each and more from turn to turn. ``floor`` is a score that
        ``k`` documents outside of this index reach; the search may also stop when the threshold falls strictly below it.
        """
        start, length = self.bounds[terms], np.diff(self.bounds)[terms]
        docs, scores, depth, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_DEPTH
        while (length > depth).any():
            seen = np.concatenate([self.list_docs[a + depth : a + min(depth + step, n)] for a, n in zip(start.tolist(), length.tolist(), strict=True) if n > depth])
            depth, step = depth + step, 2 * step
            fresh = np.unique(seen[self.stamps[seen] != stamp])
            self.stamps[fresh] = stamp
            if len(fresh):
                found = self.scores(fresh, terms, times)
                docs, scores = np.r_[docs, fresh[found > 0]], np.r_[scores, found[found > 0]]
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
            left = length > depth
            threshold = int((self.list_impacts[start[left] + depth - 1] * times[left]).sum())
            if threshold < max(floor, int(scores[k - 1]) if len(scores) == k else 0):
                break
        return docs, scores


def search_block(forward: DataFrame, block: list[tuple[int | None, dict[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of each item within each task: ``(item, item_id, doc_id, score)``, ``item`` the place in the block."""
    items = [(item_id, np.array(sorted(times), np.int64), np.array([times[t] for t in sorted(times)], np.int64)) for item_id, times in block]
    shared = Shared(forward.sparkSession, (items, weights))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, postings, rows = [], 0, 0
        for batch in small_slices(batches, "terms"):
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            rows += batch.num_rows
            if postings >= CHUNK_POSTINGS or rows >= CHUNK_DOCS:
                yield pa.Table.from_batches(held)
                held, postings, rows = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        for table in chunks(batches):
            table = table.sort_by("doc_id").combine_chunks()  # null last
            ids, lost = table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_null().to_numpy()
            lists = table.column("terms").combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            terms, times = lists.flatten().to_numpy().astype(np.int64), table.column("times").combine_chunks().flatten().to_numpy()
            if not len(terms):
                continue
            index = Index(table.column("n").to_numpy(), counts, terms, times, weights, n_docs, n_terms)
            for stamp, (_, wanted, often) in enumerate(items):
                old_ids, old_lost, old_scores = best[stamp]
                docs, scores = index.best(stamp, wanted, often, k, int(old_scores[k - 1]) if len(old_scores) == k else 0)
                if len(docs):
                    all_ids, all_lost, all_scores = np.r_[old_ids, ids[docs]], np.r_[old_lost, lost[docs]], np.r_[old_scores, scores]
                    order = np.lexsort((all_ids, all_lost, -all_scores))[:k]
                    best[stamp] = all_ids[order], all_lost[order], all_scores[order]
        sizes = [len(x[0]) for x in best]
        if sum(sizes):
            item = np.repeat(np.arange(len(items)), sizes)
            names = pa.array([x[0] for x in items], pa.int64()).take(pa.array(item))
            ids, lost, scores = (np.concatenate([x[c] for x in best]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(item), names, pa.array(ids, mask=lost), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return forward.mapInArrow(lean(run), "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> ``(item_id, rank, doc_id, score)``: each item's ``k`` best documents.

    Equal scores rank by doc_id, null last. Rows of ``docs`` that repeat an id are documents of their own; equal rows
    of ``items`` are one item, and different texts under one id are ranked each by itself. Items without a term, and
    those that no document scores above 0 for, have no row; null and empty texts hold no term and are not among the documents
    that are counted. Other columns are ignored. Empty tables give an empty result.
    """
    spark, found = docs.sparkSession, None
    for block in item_blocks(items):
        number: dict[bytes, int] = {}
        numbered = [(item_id, {number.setdefault(w, len(number)): n for w, n in times.items()}) for item_id, times in block]
        forward, path = materialize(forward_index(docs, Shared(spark, number)), "forward")
        n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
        docs_with = np.zeros(len(number), np.int64)
        for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row per term of the block
            docs_with[r["t"]] = r["df"]
        best = search_block(forward, numbered, term_weights(docs_with, n_docs), n_docs, n_terms or 1, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked, _ = materialize(best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
        drop_path(spark, path)
        found = ranked if found is None else found.union(ranked)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
