"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.components import with_value


class Shared:
    """A broadcast value pickled with its class, so executors need no copy of this package on their path."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.held: tuple = ()

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "held": ()}

    @property
    def value(self):
        if not self.held:
            self.held = (pickle.loads(self.sent.value),)
        return self.held[0]


def small_rows(spark: SparkSession) -> None:
    """Session setting of the registered queries and the pipeline: rows are whole documents, so the JVM sends 1,000 at a time.

    The operators do not depend on it; they cut batches by bytes themselves.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@contextmanager
def no_guessed_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside meet by a shuffle unless a broadcast is asked for.

    Every table under 10 MB otherwise passes through the driver, and rounds of joins hold many of these at once.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most_bytes`` bytes of a text, binary or list column; a larger value stands alone."""
    for batch in batches:
        values = batch.column(column)
        length = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + most_bytes, side="right"))))
            yield batch.slice(start, end - start)
            start = end


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving a task's memory back to the system when it ends.

    Workers live on between tasks, and what their caches and arrays have held otherwise stays with them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # other C libraries lack it
            trim(0)

    return task


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model here learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def group_edges(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (row, root) of the components of a symmetric boolean matrix; each component hangs on its first row."""
    n = len(adjacent)
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        edge = np.array([start])
        while len(edge):
            reach = adjacent[edge].any(axis=0) & (root < 0)
            edge = np.flatnonzero(reach)
            root[edge] = start
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup key-sorted batches into tables that hold whole groups; holds one batch and the open group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(keys != keys[-1])
        cut = int(starts[-1]) + 1 if len(starts) else 0
        if not cut and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        ready = [x for x in held if x.num_rows]
        if ready:
            yield pa.Table.from_batches(ready)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def split_hot(df: DataFrame, key: str, item: str, most: int, weight: str | None = None) -> DataFrame:
    """Rows whose ``key`` occurs at least twice, with ``unit`` (the comparison unit's number) and ``side``.

    Groups of more than ``most`` rows (or of more ``weight`` in all) are cut into chunks by the item's hash; each pair of chunks is
    a unit of its own, so all pairs of a group are still met while no task holds the whole group. Sizes combine
    before their shuffle, and those of hot keys are broadcast, so no task reads a hot key's rows either.
    ``side`` is 0 and 1 for the two chunks of a pair, 2 where the unit is compared with itself.
    """
    sized = with_value(df, key, F.when(F.count("*") > 1, F.sum(weight) if weight else F.count("*")), "_n").where("_n IS NOT NULL")
    parts = F.ceil(F.col("_n") / F.lit(most)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(item), F.lit(7)), parts).cast("int")
    pair = F.when(parts <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.struct(F.least(F.col("_c"), other).alias("i"), F.greatest(F.col("_c"), other).alias("j")))
    )
    units = sized.withColumn("_c", mine).withColumn("_p", F.explode(pair))
    side = F.when(F.col("_p.i") == F.col("_p.j"), 2).when(F.col("_c") == F.col("_p.i"), 0).otherwise(1).cast("int")
    return units.withColumn("unit", F.xxhash64(F.col(key), F.col("_p.i"), F.col("_p.j"))).withColumn("side", side).drop("_n", "_c", "_p")


def arrow_map(schema: str, one: Callable[[pa.RecordBatch], pa.RecordBatch], column: str) -> tuple[Callable, str]:
    """A mapInArrow function from a function of one small batch; ``column`` holds the long values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, column):
            yield one(batch)

    return lean(run), schema
