"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers.

Rows are numbered by (bucket of a hash of id, checksum and size; these three); a Feistel network over the smallest even-bit
domain, with cycle walking, permutes the numbers ``0..n-1``. The permuted number gives shard (its
remainder) and slot (its quotient), and the inverse gives the row number back, so both are computable
without looking at other rows. Shard sizes differ by one row at most (law ``rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
BUCKETS = 4096


def _halves(n: int) -> int:
    """Bits of each half of the smallest even-bit domain with ``n`` numbers."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _mix(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64((1 << bits) - 1)


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(0, 2**63, ROUNDS, dtype=np.uint64)]


def _walk(values: np.ndarray, n: int, step) -> np.ndarray:
    """Apply ``step`` until every value is under ``n``; cycles of a permutation always lead back."""
    out = step(np.asarray(values, dtype=np.uint64))
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of row numbers under the permutation of ``0..n-1`` that ``seed`` names."""
    bits, keys = _halves(n), _keys(seed)
    mask = np.uint64((1 << bits) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & mask
        for k in keys:
            left, right = right, left ^ _mix(right, k, bits)
        return (left << np.uint64(bits)) | right

    return _walk(rows, n, step)


def restore(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers of places: the inverse of :func:`permute`."""
    bits, keys = _halves(n), _keys(seed)
    mask = np.uint64((1 << bits) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & mask
        for k in reversed(keys):
            left, right = right ^ _mix(left, k, bits), left
        return (left << np.uint64(bits)) | right

    return _walk(places, n, step)


def number_rows(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Adds ``row`` (gapless from 0) by (bucket of the order columns' hash, order columns); also the count.

    Only bucket sizes, at most ``buckets`` numbers, pass through the driver.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = sorted((r["_bucket"], r["n"]) for r in dealt.groupBy("_bucket").agg(F.count("*").alias("n")).collect())
    before = np.r_[0, np.cumsum([n for _, n in sizes])]
    offsets = spark.createDataFrame([(b, int(o)) for (b, _), o in zip(sizes, before, strict=False)], "_bucket int, _offset long")
    place = F.row_number().over(_window(order)) - 1
    numbered = dealt.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    return numbered.withColumn("row", F.col("_offset") + F.col("_place")).drop("_bucket", "_place", "_offset"), int(before[-1])


def _window(order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy("_bucket").orderBy(*order)


def shard(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty in size and checksum. Null
    and repeated ids are numbered like any other (ties fall to checksum, then size). Extra columns are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permute(batch.column("row").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                ["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    placed = numbered.select("doc_id", "size", "text_crc32", "row").mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
