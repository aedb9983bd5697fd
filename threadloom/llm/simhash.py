"""SimHash near-duplicate groups with pivot distance tables.

Fingerprints are computed in Arrow batches, collapsed to distinct values, and joined on pairs of
bit blocks: two fingerprints that differ in at most ``max_bits`` of 64 bits agree on at least two of
``max_bits + 2`` blocks, so nobody is missed. Inside such a unit of comparison, distances to fixed
reference fingerprints are tabulated, pairs whose largest coordinate difference exceeds ``max_bits``
are discarded (triangle inequality), and the survivors are verified bit by bit. Only spanning links
leave a unit; components come from large-star/small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import Shared, arrow_map, by_group, group_edges, lean, small_slices, split_hot
from threadloom.operators.components import components_of_edges, with_found
from threadloom.session import drop_path, materialize

SEED = 42
PIVOTS = 24
UNIT_ROWS = 2048
BITMAP_WORDS = 16
BUCKET_BITS = 18
SET_HASHES = 1_000_000
KEY_BITS = 23
CACHE_KEYS = 200_000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ASCII-lower-cased, ASCII-white-space words; fewer words make one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest, starts = xxhash.xxh64_intdigest, [0, *ends]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype="<u8")


def ones_of(h: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits; unpacks some at a time, so long texts take no more memory."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def majority(ones: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """Fingerprints whose bits are those set in over half of the hashes."""
    return np.packbits(ones * 2 > sizes, axis=-1, bitorder="little").view("<u8")


def simhash64(text: bytes, shingle: int) -> int:
    """Fingerprint of one text; no word gives 0."""
    h = shingle_hashes(text, shingle)
    return int(majority(ones_of(h), len(h))[0]) if len(h) else 0


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``, fp a signed long; a null text counts as empty."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("body").to_pylist()
        values = np.array([simhash64(t or b"", shingle) for t in texts], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    run, schema = arrow_map("doc_id long, fp long", one, "body")
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, schema)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the fixed reference fingerprints, one row a reference."""
    references = np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)
    return np.bitwise_count(references[:, None] ^ fps[None, :]).astype(np.int16)


def near_matrix(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Boolean matrix of the pairs within ``max_bits``: pivot filter first, exact check of what is left."""
    a, b = pivot_table(left), pivot_table(right)
    rows, cols = np.nonzero(np.abs(a[0][:, None] - b[0][None, :]) <= max_bits)
    for p in range(1, PIVOTS):
        keep = np.abs(a[p][rows] - b[p][cols]) <= max_bits
        rows, cols = rows[keep], cols[keep]
    keep = np.bitwise_count(left[rows] ^ right[cols]) <= max_bits
    out = np.zeros((len(left), len(right)), dtype=bool)
    out[rows[keep], cols[keep]] = True
    return out


def small_pairs(unit: np.ndarray, fps: np.ndarray, max_bits: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of many small units at once; ``unit`` is sorted and no unit has more than ``longest`` rows."""
    table, found = pivot_table(fps), []
    for gap in range(1, longest):
        at = np.flatnonzero(unit[gap:] == unit[:-gap])
        for p in range(PIVOTS):
            at = at[np.abs(table[p][at] - table[p][at + gap]) <= max_bits]
        at = at[np.bitwise_count(fps[at] ^ fps[at + gap]) <= max_bits]
        found.append(np.stack([at, at + gap]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return both[0], both[1]


def near_links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``distinct(fp)`` -> spanning links ``(src, dst)`` among fingerprints within ``max_bits``."""
    blocks = max_bits + 2
    cuts = [64 * k // blocks for k in range(blocks + 1)]

    def block(k: int):
        return F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))

    keys = F.array(*(F.xxhash64(F.lit(n), block(i), block(j)) for n, (i, j) in enumerate(combinations(range(blocks), 2))))
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    units = split_hot(keyed, "key", "fp", UNIT_ROWS).select("unit", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "unit"):
            unit, side = (table.column(c).to_numpy() for c in ("unit", "side"))
            fps = table.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[starts, len(unit)])
            small = np.repeat((sizes <= 32), sizes) & (side == 2)
            links = []
            if small.any():
                f = fps[small]
                a, b = small_pairs(unit[small], f, max_bits, int(sizes[sizes <= 32].max()))
                links.append(np.stack([f[a], f[b]]))
            for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
                if small[s]:
                    continue
                f, where = fps[s : s + n], side[s : s + n]
                whole = near_matrix(f, f, max_bits) & ((where[:, None] == 2) | (where[:, None] != where[None, :]))
                a, b = group_edges(whole)
                links.append(np.stack([f[a], f[b]]))
            if links:
                got = np.concatenate(links, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["src", "dst"])

    placed = units.repartition("unit").sortWithinPartitions("unit")
    return placed.mapInArrow(lean(run), "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)``; component_id is the smallest doc_id reachable.

    Nulls and texts without a word have fingerprint 0 and link like any other. Rows that repeat a
    doc_id all appear. A null doc_id keeps its row; it never names a component unless it is alone.
    Extra columns are ignored. An empty table gives an empty result.
    """
    prints, _ = materialize(fingerprints(docs, shingle), "simhash")
    distinct, _ = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_rows")), "simhash-distinct")
    linked = components_of_edges(near_links(distinct.select("fp"), max_bits))
    member = linked.withColumnRenamed("id", "fp").join(distinct, "fp")
    lowest = member.groupBy("component").agg(F.min("first_id").alias("low"))
    named, _ = materialize(
        distinct.join(member.join(lowest, "component").select("fp", "low"), "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id"), "_rows"), "simhash-named"
    )
    return with_found(prints, named, "fp", "component_id").select("doc_id", "fp", "component_id")


def profile(text: bytes, shingle: int) -> tuple[int, int, int, bytes, bytes]:
    """Key of the text's copies, 64-bit fingerprint, number of distinct shingles, their parity bitmap, and their sorted hashes.

    Bit ``k`` of the bitmap tells whether an odd number of hashes falls on ``k``; so two bitmaps differ in at most
    as many bits as there are shingles that only one of the texts has. It has 1,024 bits, doubled until they are as
    many as the shingles; a longer one folds to a shorter one by the parity of its halves.
    """
    h = shingle_hashes(text, shingle)
    once = np.unique(h)
    fp = int(majority(ones_of(h), len(h))[0]) if len(h) else 0
    bits = 64 * BITMAP_WORDS
    while bits < len(once):
        bits *= 2
    odd = np.bincount((once % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    sets = once.tobytes()
    return xxhash.xxh64_intdigest(sets + fp.to_bytes(8, "little"), SEED), fp, len(once), np.packbits(odd.astype(np.uint8)).tobytes(), sets


def profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, key, fp, size, bitmap, shingles)``, shingles as the bytes of their hashes."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, fps, sizes, bitmaps, sets = zip(*(profile(t or b"", shingle) for t in batch.column("body").to_pylist()), strict=True)
        longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (keys, fps)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(sizes, pa.int32()), pa.array(bitmaps, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "key", "fp", "size", "bitmap", "shingles"])

    run, schema = arrow_map(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp long, size int, bitmap binary, shingles binary", one, "body")
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, schema)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many of the hashes in ``rows(shingles)`` fall into each of ``2 ** BUCKET_BITS`` buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, "<i8")
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "<u8")
            total += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in np.split(total, 64)], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    parts = rows.select("shingles").mapInArrow(lean(count), "slice int, counts binary").repartition("slice").mapInArrow(lean(add), "slice int, counts binary").collect()
    out = np.zeros((64, (1 << BUCKET_BITS) // 64), np.int64)
    for r in parts:
        out[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    return out.reshape(-1)


def chunk_units(h: np.ndarray, owner: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Comparison units of the rows ``(hash, owner)``: ``(row, unit, side)``.

    A hash with one part is a unit itself (side 2). One with more parts has a unit for every pair of parts; its
    owner's hash picks its part, and the row goes into the unit of each pair that holds it, as in ``split_hot``.
    """
    plain = np.flatnonzero(parts <= 1)
    rows, units, sides = [plain], [h[plain].view(np.int64)], [np.full(len(plain), 2, np.int8)]
    for k in np.flatnonzero(parts > 1).tolist():
        n, own = int(parts[k]), int(owner[k]) * 0x9E3779B97F4A7C15 % 2**64 >> 20
        mine, others = own % n, np.arange(n)
        low, high = np.minimum(mine, others), np.maximum(mine, others)
        pair = (low * n + high + 1).astype(np.uint64)
        rows.append(np.full(n, k))
        units.append(((h[k] ^ (pair * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)).view(np.int64))
        sides.append(np.where(low == high, 2, np.where(mine == low, 0, 1)).astype(np.int8))
    return np.concatenate(rows), np.concatenate(units), np.concatenate(sides)


def prefixes(rows: DataFrame, similarity: float) -> DataFrame:
    """``rows(key, shingles)`` -> ``(id, unit, side)``: of n hashes the first ``n - ceil(similarity * n) + 1`` in one order of all hashes.

    Two sets of at least this similarity share ``similarity * n`` hashes, so whatever the order their prefixes
    meet. It goes by the size of a hash's bucket, so that wording that many documents hold comes last. A bucket
    of over eight times the mean size may hold a hot hash; its hashes are dealt into pairs of chunks of about
    ``UNIT_ROWS`` rows here, so that no unit holds more than a small share of all rows. A key leaves a task once
    while the task remembers it; repeated rows may stay.
    """
    counts = bucket_counts(rows)
    heavy = counts > 8 * counts.mean() + 64
    shared = Shared(rows.sparkSession, (counts, np.where(heavy, -(-counts // UNIT_ROWS), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts = shared.value
        seen: set[int] = set()
        for batch in small_slices(batches, "shingles", most_bytes=4 << 20):
            keys, sets = batch.column("key").to_numpy(), batch.column("shingles").to_pylist()
            if len(seen) > CACHE_KEYS:
                seen.clear()
            new = [k for k, key in enumerate(keys.tolist()) if not (key in seen or seen.add(key))]
            sizes = np.array([len(sets[k]) // 8 for k in new], np.int64)
            h = np.frombuffer(b"".join([sets[k] for k in new]), "<u8")
            if not len(h):
                continue
            owner = np.repeat(np.arange(len(new)), sizes)
            h = h[np.lexsort((h, counts[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], owner))]
            rank = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = rank <= (sizes - np.ceil(similarity * sizes).astype(np.int64))[owner]
            h, ids = h[kept], keys[new][owner[kept]]
            at, unit, side = chunk_units(h, ids, parts[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(unit), pa.array(side)], ["id", "unit", "side"])

    return rows.select("key", "shingles").mapInArrow(lean(run), "id long, unit long, side byte")


def may_be_similar(apart: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, of which at least ``apart`` elements are not common, can have the similarity."""
    both = left + right
    fits = np.minimum(left, right) >= similarity * np.maximum(left, right)
    return fits & (both - apart >= similarity * (both + apart) - 1e-6)


def folded(bitmap: bytes, words: int) -> np.ndarray:
    """A parity bitmap at ``words`` words of 64 bits."""
    out = np.frombuffer(bitmap, "<u8")
    return out if len(out) == words else out[:words] ^ out[words:]


def unit_links(unit: np.ndarray, ids: np.ndarray, size: np.ndarray, bits: np.ndarray, long: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the pairs inside units that may be similar; pairs of two ``long`` rows are left to their own length. ``unit`` is sorted."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[starts, len(unit)])
    few = np.flatnonzero(np.repeat(sizes <= 32, sizes))
    links = [np.zeros((2, 0), ids.dtype)]
    for gap in range(1, int(sizes[sizes <= 32].max(initial=1))):
        a, b = few[:-gap], few[gap:]
        same = (unit[a] == unit[b]) & ~(long[a] & long[b])
        a, b = a[same], b[same]
        near = may_be_similar(np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64), size[a], size[b], similarity)
        links.append(np.stack([ids[a[near]], ids[b[near]]]))
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        near = np.zeros((n, n), bool)
        for at in range(0, n, 128):
            rows = slice(s + at, s + min(at + 128, n))
            apart = np.zeros((rows.stop - rows.start, n), np.int64)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[rows, k][:, None] ^ bits[s : s + n, k][None, :])
            near[at : at + 128] = may_be_similar(apart, size[rows][:, None], size[s : s + n][None, :], similarity) & ~(long[rows][:, None] & long[s : s + n][None, :])
        a, b = group_edges(near)
        links.append(np.stack([ids[s + a], ids[s + b]]))
    src, dst = np.concatenate(links, axis=1)
    return src, dst


def candidate_links(distinct: DataFrame, prefix: DataFrame, similarity: float) -> DataFrame:
    """``distinct(id, size, bitmap)``, ``prefix(id, unit, side)`` -> links ``(src, dst)`` that connect every pair of this similarity.

    Rows meet on a common prefix hash; sizes and bitmaps discard only pairs that cannot be that similar. Units
    of one id leave after one shuffle, and units of the same ids (near copies share many hashes) become one,
    before the bitmaps are joined.
    """
    inside = Window.partitionBy("unit")
    ids = F.xxhash64(F.count("*").over(inside), F.bit_xor(F.xxhash64("id")).over(inside), F.bit_xor(F.xxhash64("id", F.lit(7))).over(inside))
    met = prefix.repartition("unit").distinct().select("id", ids.alias("ids"), F.count("*").over(inside).alias("n")).where("n > 1")
    units = met.select("id", F.col("ids").alias("unit")).distinct().join(distinct, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "unit"):
            unit, ids, size = (table.column(c).to_numpy() for c in ("unit", "id", "size"))
            bitmaps = table.column("bitmap").to_pylist()
            lengths = np.array([len(x) // 8 for x in bitmaps])
            for words in np.unique(lengths).tolist():  # similar sets have bitmaps of one length or one twice the other
                own = np.flatnonzero((lengths == words) | (lengths == 2 * words))
                bits = np.stack([folded(bitmaps[k], words) for k in own])
                src, dst = unit_links(unit[own], ids[own], size[own].astype(np.int64), bits, lengths[own] > words, similarity)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(run), "src long, dst long").distinct()


def key_bits(ids: DataFrame) -> np.ndarray:
    """Boolean array over the low ``KEY_BITS`` bits of ids: which of them occur in ``ids(id)``; 1 MB of bits pass through the driver."""
    place = F.col("id").bitwiseAND(F.lit((1 << KEY_BITS) - 1)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << KEY_BITS) + 32768, bool)
    for r in rows:
        out[(r.b - 1) * 32768 : r.b * 32768] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return out[: 1 << KEY_BITS]


def set_edges(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (row, root) of the components that pairs of at least this Jaccard similarity form; no set is empty."""
    sizes = np.array([len(x) for x in sets])
    bounds = np.r_[0, np.cumsum(sizes)]
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    free, root = np.ones(len(sets), bool), np.arange(len(sets))
    for first in range(len(sets)):
        todo = [first] if free[first] else []
        free[first] = False
        while todo and free.any():
            x = todo.pop()
            mark = np.zeros(int(place.max()) + 1, bool)
            mark[place[bounds[x] : bounds[x + 1]]] = True
            common = np.add.reduceat(mark[place], bounds[:-1], dtype=np.int64)
            found = np.flatnonzero(free & (common >= similarity * (sizes + sizes[x] - common)))
            free[found], root[found] = False, first
            todo.extend(found.tolist())
    rows = np.flatnonzero(root != np.arange(len(sets)))
    return rows, root[rows]


def similar_links(rows: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """``rows(key, shingles)``, ``distinct(id, size, bitmap)`` -> spanning links ``(src, dst)`` of the pairs of at least this Jaccard similarity.

    Candidate links only bring documents together; inside their components the shingle sets are compared, chunk by
    chunk where they hold over ``SET_HASHES`` hashes together.
    """
    candidates, _ = materialize(candidate_links(distinct, prefixes(rows, similarity), similarity), "candidates")
    together, _ = materialize(components_of_edges(candidates), "together")
    units = split_hot(together.join(distinct.select("id", "size"), "id"), "component", "id", SET_HASHES, "size").select("id", "unit")
    wanted = Shared(rows.sparkSession, key_bits(together.select("id")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value[batch.column("key").to_numpy() & ((1 << KEY_BITS) - 1)]))

    near = rows.select("key", "shingles").mapInArrow(lean(pick), "key long, shingles binary")
    sets = near.groupBy(F.col("key").alias("id")).agg(F.first("shingles").alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "unit"):
            unit, ids = (table.column(c).to_numpy() for c in ("unit", "id"))
            hashes = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(unit)], strict=True):
                if e - s > 1:
                    a, b = set_edges(hashes[s:e], similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][a]), pa.array(ids[s:e][b])], ["src", "dst"])

    return units.join(sets, "id").repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(run), "src long, dst long")


def near_groups(docs: DataFrame, shingle: int = 5, max_bits: int = 4, similarity: float = 0.8) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, component_id)`` by near 64-bit fingerprints and by Jaccard similarity of shingle sets.

    Copies collapse first (equal shingle sets and 64-bit fingerprints). Nulls, empty texts and texts without a
    word are copies of each other. Rows that repeat a doc_id all appear, each in the group of its own text.
    ``doc_id`` may be of any ordered type; the smallest that is not null names a component, a null only where
    there is no other. An empty table gives an empty result.
    """
    rows, path = materialize(profiles(docs, shingle), "profiles")
    distinct, _ = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.count("*").alias("_rows")), "profiles-distinct")
    by_fp = distinct.groupBy("fp").agg(F.min("key").alias("head"))
    same = distinct.join(by_fp, "fp").where("key <> head").select(F.col("key").alias("src"), F.col("head").alias("dst"))
    near = near_links(by_fp.select("fp"), max_bits)
    near = near.join(by_fp.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(by_fp.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    similar, _ = materialize(similar_links(rows, distinct.select(F.col("key").alias("id"), "size", "bitmap"), similarity), "similar")
    keys, _ = materialize(rows.select("doc_id", "key"), "keys")
    drop_path(docs.sparkSession, path)  # the shingles are larger than the texts
    linked = components_of_edges(same.union(near).union(similar))
    member = linked.withColumnRenamed("id", "key").join(distinct.select("key", "first_id"), "key")
    lowest = member.groupBy("component").agg(F.min("first_id").alias("low"))
    named, _ = materialize(distinct.select("key", "first_id", "_rows").join(member.join(lowest, "component").select("key", "low"), "key", "left").select("key", F.coalesce("low", "first_id").alias("component_id"), "_rows"), "profiles-named")
    return with_found(keys, named, "key", "component_id").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, max_bits: int = 4, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns whatever their names, with one row left of each group of near copies.

    That is the row with the smallest doc_id; rows without an id come after all others, and rows of one id in the
    order of two hashes of their texts. So different texts under one id are judged apart, and of rows equal in id
    and text the one stays whose other columns have the smallest hash. Nulls, empty texts and texts without a word
    are one group. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    rows = docs.select(name.alias("name"), F.struct("*").alias("row"))
    groups = near_groups(docs.select(name.alias("doc_id"), "text"), shingle, max_bits, similarity).withColumnRenamed("doc_id", "name")
    kept, _ = materialize(groups.where("name = component_id").groupBy("name").agg(F.count("*").alias("copies")), "kept")
    flat = kept.select("name.lost", "name.id", "name.h1", "name.h2", "copies")
    placed = rows.select("name.lost", "name.id", "name.h1", "name.h2", "row")
    keys = F.coalesce("id", F.lit(0))
    met = placed.withColumn("k", keys).join(flat.withColumn("k", keys).drop("id"), ["lost", "k", "h1", "h2"])
    others = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]
    first = met.where("copies > 1").groupBy("lost", "k", "h1", "h2").agg(F.min_by("row", F.xxhash64(F.lit(0), *others)).alias("row"))
    return met.where("copies = 1").select("row.*").union(first.select("row.*"))
