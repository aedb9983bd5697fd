"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over word windows ignore some positions, so a window with a substituted word still
matches where the substitution falls on an ignored position. The benchmark is taken as a stated query
set in blocks of bounded size: each block's mask hashes are broadcast as sorted arrays and every
document window is looked up against them, without moving any text. Around each hit the document and
the benchmark item are aligned word by word and the best stretch with enough equal words is kept. The masks
follow from the rule of what counts, so that one of them fits every stretch that does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Shared, lean, small_slices

WORD = re.compile(r"\w+")
BLOCK_WORDS = 500_000
CACHE_WORDS = 200_000
LONG_WORD = 64  # longer words are not kept
SPREAD = 1 << 20
FILTER_BITS = 20


@dataclass
class Block:
    """One bounded block of the benchmark, ready for lookup."""

    items: list[int | None]
    starts: np.ndarray
    words: np.ndarray
    masks: list[tuple[np.ndarray, np.ndarray]]  # offsets and odd multipliers
    filters: list[np.ndarray]
    hashes: list[np.ndarray]
    places: list[np.ndarray]


def word_hashes(text: str | None, cache: dict[str, int]) -> list[int]:
    """64-bit hashes of the lower-cased words of a text."""
    if not text:
        return []
    words = WORD.findall(text.lower())
    out = list(map(cache.get, words))
    if None in out:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for k, w in enumerate(words):
            if out[k] is None:
                out[k] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 1)
                if len(w) <= LONG_WORD:
                    cache[w] = out[k]
    return out


def masked(words: np.ndarray, offsets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of the compared positions of every window; one value per window start."""
    n = len(words) - int(offsets[-1])
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for o, f in zip(offsets.tolist(), factors, strict=True):
            out += words[o : o + n] * f
        out ^= out >> np.uint64(29)
    return out


def sure_masks(similarity: float, least: int) -> list[str]:
    """Masks of which one fits every stretch of ``least`` equal words or more whose share of equal words is ``similarity`` or more.

    A mask of h compared words on either side of an ignored one fits a run of 2h + 1 equal words, and two runs of h around one
    unequal word. A stretch with m unequal words has m + 1 runs, some perhaps empty. Where the mask fits nowhere, none is longer than 2h
    and of two neighbours one is shorter than h, so there are at most as many equal words as in runs of 2h and h - 1 by
    turns. The largest h is taken for which that is too few whatever m. Below a similarity for which no h is, the mask is a run.
    """
    if similarity >= 1:
        return ["1" * (least - 1 - least // 2) + "0" + "1" * (least // 2)] if least > 2 else ["1" * least]
    needs = [(m, max(least, int(np.ceil(similarity * m / (1 - similarity) - 1e-9)))) for m in range(1000)]
    fits = [h for h in range(1, least) if all((m // 2 + 1) * 2 * h + (m + 1) // 2 * (h - 1) < n for m, n in needs)]
    if fits:
        return ["1" * max(fits) + "0" + "1" * max(fits)]
    return ["1" * min(-(-n // (m + 1)) for m, n in needs)]


def build_block(rows: list[tuple[int | None, str]], least_words: int, masks: list[str]) -> Block:
    """Hash tables of benchmark rows ``(item_id, text)``; items shorter than a mask also get a contiguous mask of their length."""
    cache: dict[str, int] = {}
    kept = [(i, h) for i, text in rows if len(h := word_hashes(text, cache)) >= least_words]
    sizes = np.array([len(h) for _, h in kept], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    words = np.array([x for _, h in kept for x in h], dtype=np.uint64)
    owner = np.repeat(np.arange(len(kept)), sizes)
    rng = np.random.default_rng(4)
    shapes = [np.flatnonzero([c == "1" for c in m]) for m in masks]
    shapes += [np.arange(n) for n in sorted({int(n) for n in sizes if n < min(map(len, masks))})]
    block = Block([i for i, _ in kept], starts, words, [], [], [], [])
    for offsets in shapes:
        factors = rng.integers(0, 2**63, len(offsets), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = masked(words, offsets, factors)
        at = np.flatnonzero(owner[: len(h)] == owner[int(offsets[-1]) :]) if len(h) else np.zeros(0, np.int64)
        order = at[np.argsort(h[at], kind="stable")]
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(h[at] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        block.masks.append((offsets, factors))
        block.filters.append(bits)
        block.hashes.append(h[order])
        block.places.append(order)
    return block


def best_stretch(equal: np.ndarray, similarity: float, least: int) -> tuple[int, int] | None:
    """Bounds of the stretch with ``least`` equal words or more that exceeds the share ``similarity`` by most words; None where all fall short of it."""
    count = np.r_[0, np.cumsum(equal)]
    if count[-1] < least:
        return None
    total = np.round(count - similarity * np.arange(len(count)), 9)
    last = np.searchsorted(count, count - least, side="right") - 1  # the latest start that leaves ``least`` equal words
    gain = np.where(last >= 0, total - np.minimum.accumulate(total)[last], -1.0)
    end = int(np.argmax(gain))
    return (int(np.argmin(total[: last[end] + 1])), end) if gain[end] >= 0 else None


def overlaps(block: Block, docs: list[list[int]], similarity: float, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """``(doc index, item index, first word, words, matched)``: the best stretch of every item met in every document."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    if not len(block.words) or not sizes.sum():
        return []
    bounds = np.r_[0, np.cumsum(sizes)]
    words = np.fromiter((x for d in docs for x in d), np.uint64, int(bounds[-1]))
    owner = np.repeat(np.arange(len(docs)), sizes)
    diagonals = np.zeros((3, 0), np.int64)
    for (offsets, factors), bits, hashes, places in zip(block.masks, block.filters, block.hashes, block.places, strict=True):
        h = masked(words, offsets, factors)
        at = np.flatnonzero(bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[owner[at] == owner[at + int(offsets[-1])]]
        first, last = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], side="right")
        many = last - first
        at, many = at[many > 0], many[many > 0]
        if not len(at):
            continue
        first = np.searchsorted(hashes, h[at])
        cuts = np.searchsorted(np.cumsum(many), np.arange(SPREAD, int(many.sum()), SPREAD), side="right")
        for a, f, n in zip(*(np.split(x, cuts) for x in (at, first, many)), strict=True):  # hits are spread some at a time
            rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place, spot = places[np.repeat(f, n) + rank], np.repeat(a, n)
            item = np.searchsorted(block.starts, place, side="right") - 1
            met = np.stack([owner[spot], item, spot - place + block.starts[item]])
            diagonals = np.unique(np.concatenate([diagonals, met], axis=1), axis=1)
    doc, item, start = diagonals
    low, high = np.maximum(bounds[doc], start), np.minimum(bounds[doc + 1], start + np.diff(block.starts)[item])
    least = np.minimum(least_words, np.diff(block.starts)[item])
    total = equal_counts(words, block.words, low, block.starts[item] + low - start, high - low)
    kept = np.flatnonzero(total >= least)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for k in kept[np.lexsort((start[kept], -total[kept], item[kept], doc[kept]))].tolist():  # the most equal words first
        pair, a, n = (int(doc[k]), int(item[k])), int(low[k]), int(high[k] - low[k])
        matched, from_, _, _ = best.get(pair, (0, 0, 0, 0))
        if total[k] < matched or (total[k] == matched and start[k] > from_):
            continue  # it can't be better, nor as good and earlier
        probe = int(block.starts[item[k]] + low[k] - start[k])
        equal = words[a : a + n] == block.words[probe : probe + n]
        stretch = best_stretch(equal, similarity, int(least[k]))
        if stretch is None:
            continue
        s, e = stretch
        found = int(equal[s:e].sum())
        if found > matched or (found == matched and start[k] < from_):
            best[pair] = (found, int(start[k]), a - int(bounds[doc[k]]) + s, e - s)
    return [(d, i, at, n, matched) for (d, i), (matched, _, at, n) in sorted(best.items())]


def equal_counts(words: np.ndarray, probes: np.ndarray, at: np.ndarray, probe: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Equal words of the stretches of ``sizes`` words at ``at`` in ``words`` and ``probe`` in ``probes``; some are spread at a time."""
    out = np.zeros(len(at), np.int64)
    for own in np.split(np.arange(len(at)), np.searchsorted(np.cumsum(sizes), np.arange(SPREAD, int(sizes.sum()), SPREAD), side="right")):
        if len(own):
            n = sizes[own]
            starts = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(starts, n)
            out[own] = np.add.reduceat(words[np.repeat(at[own], n) + inner] == probes[np.repeat(probe[own], n) + inner], starts, dtype=np.int64)
    return out


def blocks_of(benchmark: DataFrame, similarity: float, least_words: int) -> Iterator[Block]:
    """The benchmark ``(item_id, text)`` in blocks of about ``BLOCK_WORDS`` words, dealt by the item's hash."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")))).first()[0] or 0
    count = 1 + int(total) // BLOCK_WORDS
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text", F.lit(4)), F.lit(count)) == k)
        yield build_block(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), min(5, least_words), sure_masks(similarity, least_words))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least_words: int = 10) -> DataFrame:
    """Contaminated pairs ``(doc_id, item_id, first_word, n_words, matched_words, item_words)``.

    A pair is reported when document and item agree, word for word on one alignment, on at least
    ``similarity`` of a stretch holding ``least_words`` equal words (or on the whole item where it is
    shorter). A null item_id stays null. Items of fewer than five words, null texts and empty texts never match. Repeated rows are
    all reported; extra columns are ignored; either table may be empty.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word int, n_words int, matched_words int, item_words int"
    found = None
    for block in blocks_of(benchmark, similarity, least_words):
        shared = Shared(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict[str, int] = {}
            b = shared.value
            for batch in small_slices(batches, "text"):
                got = overlaps(b, [word_hashes(t, cache) for t in batch.column("text").to_pylist()], similarity, least_words)
                if got:
                    ids = batch.column("doc_id").to_pylist()
                    rows = [(ids[d], b.items[i], first, n, matched, int(b.starts[i + 1] - b.starts[i])) for d, i, first, n, matched in got]
                    names = ["doc_id", "item_id", "first_word", "n_words", "matched_words", "item_words"]
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        part = docs.select("doc_id", "text").mapInArrow(lean(run), schema)
        found = part if found is None else found.unionByName(part)
    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least_words: int = 10) -> DataFrame:
    """Rows of ``docs``, all columns, that no benchmark item overlaps; rules as in :func:`find_overlaps`."""
    kept = docs
    for block in blocks_of(benchmark, similarity, least_words):
        shared = Shared(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict[str, int] = {}
            for batch in small_slices(batches, "text"):
                texts = batch.column("text").to_pylist()
                hit = {d for d, *_ in overlaps(shared.value, [word_hashes(t, cache) for t in texts], similarity, least_words)}
                yield batch.filter(pa.array([k not in hit for k in range(len(texts))], pa.bool_()))

        kept = kept.mapInArrow(lean(run), docs.schema)
    return kept
