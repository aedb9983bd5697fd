"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Exact copies collapse first. Each tree cuts unit vectors by one random direction per level at the
node's median, fitted on a bounded sample; vectors near a cut go both ways. Every vector of every
leaf is then compared with its leaf by cosine in double precision. A pair that meets in several
leaves is counted in the first of them only, so link counts need no list of pairs; oversized leaves
are cut into chunk pairs that separate tasks compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from threadloom.llm.shared import Shared, by_group, group_edges, lean, small_slices, split_hot
from threadloom.operators.components import components_of_edges, with_found
from threadloom.session import materialize

UNIT_ROWS = 1024
MAX_DEPTH = 31
LEAST_SAMPLE = 32
#: Chance that a level of a tree parts two vectors at the least cosine, with spill of half their distance (measured about 0.02).
PARTED = 0.021


@dataclass(frozen=True)
class Forest:
    """directions[dim][tree, level], cuts[dim][tree][level][node]; the cuts of a level are as many as the sample can tell apart."""

    directions: dict
    cuts: dict
    spill: dict


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def trees_for(depth: int, missed: float = 0.01) -> int:
    """Trees after which a pair at the least cosine is parted in all of them with chance ``missed`` or less; 4 at least."""
    kept = (1 - PARTED) ** depth
    return max(4, int(np.ceil(np.log(missed) / np.log(1 - kept)))) if kept < 1 else 4


def fit_forest(samples: dict, rows: int, min_cos: float, trees: int | None, leaf_rows: int, spill: float, seed: int) -> Forest:
    """``samples[dim]``: unit vectors. Nodes with under ``LEAST_SAMPLE`` sample rows take the cut of their parent's rows.

    Below the level at which the sample runs out, the nodes under one ancestor share the median of the ancestor's rows
    on the level's direction, so the cuts stay few however deep the trees are.
    """
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows)))))
    trees = trees or trees_for(depth)
    directions, cuts, widths = {}, {}, {}
    for dim, x in samples.items():
        rng = np.random.default_rng([seed, dim])
        d = rng.standard_normal((trees, depth, dim))
        d /= np.linalg.norm(d, axis=2, keepdims=True)
        told = max(0, int(np.log2(max(len(x) / LEAST_SAMPLE, 1))))
        per_tree = []
        for t in range(trees):
            levels, groups = [], [np.arange(len(x))]
            for level in range(depth):
                p = x @ d[t, level]
                cut = np.array([float(np.median(p[own])) if len(own) else 0.0 for own in groups])
                levels.append(cut)
                if level < told:
                    halves = [(own, half) for own, c in zip(groups, cut, strict=True) for half in (own[p[own] < c], own[p[own] >= c])]
                    groups = [half if len(half) >= LEAST_SAMPLE else own for own, half in halves]
            per_tree.append(levels)
        directions[dim], cuts[dim] = d, per_tree
        widths[dim] = spill * np.sqrt(2 - 2 * min_cos) / np.sqrt(dim)
    return Forest(directions, cuts, widths)


def route(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves of unit vectors: row ``rows[k]`` lies in leaf ``leaves[k]``; leaf numbers rise with the tree.

    Vectors of a length that the sample lacks lie in one leaf of their own.
    """
    dim, rows, leaves = x.shape[1], [], []
    if dim not in forest.directions:
        return np.arange(len(x)), np.full(len(x), np.int64(dim) << 40)
    d, width = forest.directions[dim], forest.spill[dim]
    for t in range(len(d)):
        at, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for level in range(d.shape[1]):
            cut = forest.cuts[dim][t][level]
            gap = (x @ d[t, level])[at] - cut[node >> (level - (len(cut).bit_length() - 1))]
            left, right = gap < width, gap >= -width
            at, node = np.r_[at[left], at[right]], np.r_[2 * node[left], 2 * node[right] + 1]
        rows.append(at)
        leaves.append((np.int64(dim) << 40) + (np.int64(t) << 32) + node)
    return np.concatenate(rows), np.concatenate(leaves)


def _compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, leaves: list, leaf: int, side: np.ndarray, min_cos: float) -> dict | None:
    """Links found in one unit: per row the copies linked here for the first time, and its spanning root."""
    near = (x @ x.T >= min_cos) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))
    np.fill_diagonal(near, False)
    at = np.flatnonzero(near.any(axis=1))
    if not len(at):
        return None
    near = near[np.ix_(at, at)]
    earlier = [[v for v in leaves[i] if v < leaf] for i in at]
    names = {v: k for k, v in enumerate(sorted({v for e in earlier for v in e}))}
    inside = np.zeros((len(at), len(names)), dtype=np.float32)
    for row, e in enumerate(earlier):
        inside[row, [names[v] for v in e]] = 1
    fresh = near & (inside @ inside.T < 0.5)
    rows, roots = group_edges(near)
    root = np.arange(len(at))
    root[rows] = roots
    return {"id": ids[at], "links": fresh.astype(np.int64) @ copies[at], "root": ids[at][root]}


def link_counts(vectors: DataFrame, min_cos: float, trees: int | None = None, leaf_rows: int = 512, spill: float = 0.5, fit_rows: int = 20_000, seed: int = 5) -> DataFrame:
    """``vectors(id, copies, embedding)``, distinct and finite -> partial rows ``(id, links, root)``."""
    spark = vectors.sparkSession
    total = vectors.count()
    share = min(1.0, fit_rows / max(total, 1))
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id", F.lit(seed)), "id").select("embedding").limit(2 * fit_rows).collect()
    by_dim: dict = {}
    for (v,) in picked:
        by_dim.setdefault(len(v), []).append(v)
    samples = {dim: unit_rows(own) for dim, own in by_dim.items()}
    packed = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    forest = Shared(spark, fit_forest(samples, total, min_cos, trees, leaf_rows, spill, seed))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "embedding", 4096):
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                raw = flat[starts[own][:, None] + np.arange(dim)[None, :]]
                rows, leaves = route(forest.value, unit_rows(raw))
                order = np.lexsort((leaves, rows))
                rows, leaves = rows[order], leaves[order]
                bounds = np.searchsorted(rows, np.arange(len(own) + 1))
                lists_of = [leaves[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(own)),
                        batch.column("copies").take(pa.array(own)),
                        pa.array([v.astype(packed).tobytes() for v in raw], pa.binary()),
                        pa.array(lists_of, pa.list_(pa.int64())),
                    ],
                    ["id", "copies", "vec", "leaves"],
                )

    routed, _ = materialize(vectors.select("id", "copies", "embedding").mapInArrow(lean(spread), "id long, copies long, vec binary, leaves array<long>"), "routed")
    placed = routed.select("id", "copies", "vec", "leaves", F.explode("leaves").alias("leaf"))
    units = split_hot(placed, "leaf", "id", UNIT_ROWS).repartition("unit").sortWithinPartitions("unit", "leaf")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "unit"):
            unit, leaf, side, ids, copies = (table.column(c).to_numpy() for c in ("unit", "leaf", "side", "id", "copies"))
            starts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (leaf[1:] != leaf[:-1])])
            vecs, lists = table.column("vec"), table.column("leaves")
            for s, e in zip(starts, np.r_[starts[1:], len(unit)], strict=True):
                x = unit_rows(np.stack([np.frombuffer(v, packed) for v in vecs.slice(s, e - s).to_pylist()]))
                got = _compare(ids[s:e], copies[s:e], x, lists.slice(s, e - s).to_pylist(), int(leaf[s]), side[s:e], min_cos)
                if got:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in got.items()})

    return units.select("unit", "leaf", "side", "id", "copies", "vec", "leaves").mapInArrow(lean(compare), "id long, links long, root long")


def near_vectors(table: DataFrame, min_cos: float = 0.95, **options) -> DataFrame:
    """``table(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of unequal length with each other. ``vec_id`` is taken as a key; a repeated row counts as
    one more vector. Extra columns are ignored; an empty table gives an empty result.
    """
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    keyed = table.select("vec_id", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    grouped = keyed.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    distinct, _ = materialize(grouped, "vectors")
    partial, _ = materialize(link_counts(distinct.select("id", "copies", "embedding"), min_cos, **options), "vector-links")
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    component = components_of_edges(partial.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    named = distinct.select("k1", "k2", "id", "copies").join(links, "id", "left").join(component, "id", "left")
    key, found = F.struct("k1", "k2").alias("key"), F.struct("links", "copies", "component", "id").alias("found")
    named, _ = materialize(named.select(key, found, F.col("copies").alias("_rows")), "vectors-named")
    met = with_found(keyed.where("sound").select("vec_id", key), named, "key", "found").select("vec_id", "found.*")
    none = F.lit(None).cast("long")
    out = met.union(keyed.where("NOT sound").select("vec_id", none, none, none, none))
    label = F.coalesce("component", "id", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        label.alias("component_id"),
        (F.col("vec_id") == label).alias("kept"),
    )
