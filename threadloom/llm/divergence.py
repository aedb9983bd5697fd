"""Source divergence audit: how far the wording of a language's sources lies from each other and from the whole.

A byte-level tokenizer finds the terms of a batch at once: a lookup table marks term bytes in the
concatenated UTF-8 buffer, changes of the mark are boundaries, XXH64 groups the slices, and slices of one hash
are compared byte by byte. Counts combine in the task, before the shuffle and after it. Shares are integers from counts; pair
divergences are sums over blocks of terms, each a sparse (source x term) matrix in row order whose rows are added up by ``reduceat``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import by_group, lean, small_slices
from threadloom.operators.components import with_found
from threadloom.session import materialize

SEED = 42
SCALE = 1_000_000_000
BATCH_BYTES = 12 << 20
#: Slices that are hashed or compared at once, and rows that leave a task at once.
SOME = 200_000
BLOCK_CELLS = 200_000
CHUNK_SOURCES = 256
SALTS = 64

#: ASCII letters and every byte of a character beyond ASCII belong to terms.
IS_TERM = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def boundaries(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the term slices of ``buffer``, which holds the texts between ``offsets``; no slice crosses a text's end."""
    inside = IS_TERM[buffer]
    before, after = np.zeros(len(buffer), bool), np.zeros(len(buffer), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    sizes = np.diff(offsets)
    before[offsets[:-1][sizes > 0]] = False
    after[offsets[1:][sizes > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def grouped(low: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, group)``: a slice of each distinct term, and each slice's term.

    Slices with one XXH64 are compared with the first of them, and those that differ become terms of their own.
    """
    digest, hashes = xxhash.xxh64_intdigest, np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), SOME):
        some = zip(starts[k : k + SOME].tolist(), ends[k : k + SOME].tolist(), strict=True)
        hashes[k : k + SOME] = np.fromiter((digest(low[a:b], SEED) for a, b in some), np.uint64, min(SOME, len(starts) - k))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, head = ends - starts, first[group]
    odd = sizes != sizes[head]
    data, same = np.frombuffer(low, np.uint8), np.flatnonzero(~odd)
    for k in range(0, len(same), SOME):
        own = same[k : k + SOME]
        n = sizes[own]
        inner = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(starts[own], n) + inner] != data[np.repeat(starts[head[own]], n) + inner]
        if differs.any():
            odd[np.repeat(own, n)[differs]] = True
    extra: dict[bytes, int] = {}
    heads = first.tolist()
    for k in np.flatnonzero(odd).tolist():
        word = low[starts[k] : ends[k]]
        if word not in extra:
            extra[word] = len(heads)
            heads.append(k)
        group[k] = extra[word]
    return np.array(heads, np.int64), group


def batch_cells(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(lang, source, term, n, docs)`` of a batch: occurrences and documents of each term in each group, and a row without a term per group."""
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
    number = {name: k for k, name in enumerate(dict.fromkeys(names))}
    owner = np.array([number[x] for x in names], np.int64)
    data = texts.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    starts, ends = boundaries(buffer, offsets - offsets[0])
    low = LOWER[buffer].tobytes()
    first, term = grouped(low, starts, ends)
    doc = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    held, times = np.unique(doc * max(1, len(first)) + term, return_counts=True)
    doc, term = np.divmod(held, max(1, len(first)))
    cell, where = np.unique(owner[doc] * max(1, len(first)) + term, return_inverse=True)
    n = np.bincount(where, times, len(cell)).astype(np.int64)
    docs = np.bincount(where, minlength=len(cell))
    group, term = np.divmod(cell, max(1, len(first)))
    words = pa.array([low[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
    lone = np.arange(len(number))
    group, zero = np.concatenate([group, lone]), np.zeros(len(lone), np.int64)
    langs, sources = (pa.array([x[k] for x in number], pa.string()).take(pa.array(group)) for k in (0, 1))
    terms = pa.concat_arrays([words.take(pa.array(term)), pa.nulls(len(lone), pa.string())])
    columns = [langs, sources, terms, pa.array(np.concatenate([n, zero]), pa.int64()), pa.array(np.concatenate([docs, zero]), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_cells(docs: DataFrame) -> DataFrame:
    """``docs(text, lang, source)`` without nulls -> ``(lang, source, term, n, docs)``; every group has a row without a term."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in small_slices(batches, "text", rows=20_000, most_bytes=BATCH_BYTES):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + n > BATCH_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            cells = batch_cells(batch)
            for k in range(0, cells.num_rows, SOME):
                yield cells.slice(k, SOME)

    found = docs.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, the product in 38 digits."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(11)) * CAST({count} + 2 AS DECIMAL(20))) div CAST({total} + 2 * {terms} AS DECIMAL(20))")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / (p + q))`` of 64-bit shares."""
    d = p - q
    return d * d // (p + q)


def block_sums(source: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of sums over the terms of a block of ``gap(p_i, p_j) - gap(base_i, base_j)``, i in ``left``, j in ``right``.

    ``(source, term, p)`` are the cells; a source without a cell of a term has its ``base`` share there. For a row i
    spread over all terms, the cells of the right rows are corrected and added up by row; what the row itself
    holds is added for every j.
    """
    order = np.lexsort((term, source))
    source, term, p = source[order], term[order], p[order]
    bounds = np.searchsorted(source, np.arange(len(base) + 1))
    own = np.isin(source, right)
    rows, columns, values = source[own], term[own], p[own]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    out = np.zeros((len(left), len(base)), np.int64)
    spread = np.empty(int(term.max()) + 1 if len(term) else 0, np.int64)
    for k, i in enumerate(left.tolist()):
        held = slice(bounds[i], bounds[i + 1])
        spread[:] = base[i]
        spread[term[held]] = p[held]
        if len(starts):
            other = spread[columns]
            out[k, rows[starts]] = np.add.reduceat(gap(values, other) - gap(base[rows], other), starts)
        levels, times = np.unique(p[held], return_counts=True)
        if len(levels):
            out[k] += ((gap(levels[:, None], base[None, :]) - gap(base[i], base)[None, :]) * times[:, None]).sum(axis=0)
    return out[:, right]


def unit_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Partial values ``(lang, a, b, value)`` of the units of comparison in ``table``, which is sorted by unit."""
    unit = table.column("unit").to_numpy()
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True):
        part = table.slice(s, e - s).combine_chunks()
        term = part.column("term").combine_chunks().dictionary_encode()
        names = part.column("source").combine_chunks().dictionary_encode()
        source, p, side, block, terms = (x.to_numpy(zero_copy_only=False) for x in (names.indices, *(part.column(c).combine_chunks() for c in ("p", "side", "block", "terms"))))
        head = term.indices.is_null().to_numpy(zero_copy_only=False)
        base, sides = np.zeros(len(names.dictionary), np.int64), np.zeros(len(names.dictionary), np.int64)
        base[source[head]], sides[source[head]] = p[head], side[head]
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        if not len(left) or not len(right):
            continue
        cell = ~head
        sums = block_sums(source[cell], term.indices.filter(pa.array(cell)).to_numpy(), p[cell], base, left, right)
        if block[0] == 0:
            sums += int(terms[0]) * gap(base[left][:, None], base[right][None, :]) if terms[0] else 0
        i, j = np.meshgrid(left, right, indexing="ij")
        kept = (i < j) if side[0] == 2 else np.ones(i.shape, bool)
        a, b = (names.dictionary.take(pa.array(x[kept])) for x in (i, j))
        lang = part.column("lang").combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(a), np.int64)))
        yield pa.RecordBatch.from_arrays([lang, a, b, pa.array(sums[kept])], ["lang", "a", "b", "value"])


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``cells(lang, source, term, p, info)``, ``groups(lang, source, base, info)`` -> ``(lang, source, item, value)`` of each two sources.

    Terms are dealt into blocks by hash and sources into chunks; every pair of chunks of a block is a unit of about
    ``BLOCK_CELLS`` cells. Each group has a row in all its units, since a source without a cell counts too.
    """
    chunk = F.pmod(F.xxhash64("source", F.lit(SEED)), F.col("info.chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("info.chunks") - 1))
    placed = cells.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("info.blocks")).alias("block"), "info", chunk.alias("c"), other.alias("o"))
    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("info.blocks") - 1)).alias("block"), "info", chunk.alias("c"))
    rows = placed.union(heads.select("lang", "source", "term", "p", "block", "info", "c", other.alias("o")))
    side = F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).cast("int")
    unit = F.xxhash64("lang", "block", F.least("c", "o"), F.greatest("c", "o"))
    units = rows.select(unit.alias("unit"), "lang", "source", "term", "p", side.alias("side"), "block", F.col("info.terms").alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "unit"):
            yield from unit_pairs(table)

    found = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(run), "lang string, a string, b string, value long")
    summed = found.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """``docs(text, lang, source)`` -> ``(lang, source, part, item, value, rank)``.

    Part ``pair`` has all other sources of the language with their divergence from this one, part ``term`` the ``most_terms``
    terms of the group that lie farthest above the language's share. Every row counts as a document, whatever its id,
    also where rows repeat. Nulls are read as the empty string, which is a language or source like any other; texts
    without a term still make their group occur. A language without a kept term has pairs of value 0. Equal values
    rank by the item. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    cells, _ = materialize(term_cells(texts), "divergence-cells")
    terms = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere"), F.count("*").alias("cells"))
    kept, _ = materialize(terms.where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    inner, _ = materialize(cells.join(kept.drop("cells"), ["lang", "term"]).select("lang", "source", "term", "n", "everywhere"), "divergence-kept")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("everywhere").alias("all_n"), F.sum("cells").alias("cells"))
    totals = inner.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("_rows"))
    named = cells.where("term IS NULL").select("lang", "source")
    langs = named.groupBy("lang").agg(F.count("*").alias("_rows")).join(per_lang, "lang", "left")
    chunks = F.ceil(F.col("_rows") / CHUNK_SOURCES).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.coalesce("cells", F.lit(0)) / (BLOCK_CELLS * chunks))).cast("long")
    of_lang = F.struct(F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all_n", F.lit(0)).alias("all_n"), chunks.alias("chunks"), blocks.alias("blocks"))
    groups = with_found(named, langs.select("lang", of_lang.alias("info"), "_rows"), "lang", "info").join(totals, ["lang", "source"], "left")
    base = F.when(F.col("info.terms") > 0, share("0", "coalesce(n, 0)", "info.terms")).otherwise(1)
    groups, _ = materialize(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "info", base.alias("base"), F.coalesce("_rows", F.lit(0)).alias("_rows")), "divergence-groups")
    g = F.struct("lang", "source")
    known = groups.select(g.alias("g"), F.struct("n", "info").alias("of_group"), "_rows")
    met = with_found(inner.withColumn("g", g), known, "g", "of_group")
    p, q = share("n", "of_group.n", "of_group.info.terms"), share("everywhere", "of_group.info.all_n", "of_group.info.terms")
    shares, _ = materialize(met.select("lang", "source", "term", p.alias("p"), q.alias("q"), F.col("of_group.info").alias("info")), "divergence-shares")
    pairs = pair_values(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    far = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = (F.desc("value"), F.col("item"))
    some = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(*order)
    top = far.withColumn("_place", F.row_number().over(some)).where(F.col("_place") <= most_terms).drop("_place")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    return pairs.withColumn("rank", rank).union(top.withColumn("rank", rank).where(F.col("rank") <= most_terms))
