"""Token ids in binary files: a static range asymmetric numeral system over interleaved blocks.

One frequency table, counted over all ids and scaled to ``2**SCALE``, is shared by every block. A
block holds up to ``LANES * STEPS`` ids; id ``k`` of a block belongs to coder ``k % LANES``, and the
coders of many blocks advance together in numpy. A file ends with its checkpoints (offset, first id
and length of each block), so blocks decode independently; each carries a checksum of its ids.

File layout, little-endian: ``MAGIC``; blocks (``<4I``: ids, steps, words, CRC-32 of the ids as
unsigned 32-bit integers; ``LANES`` final states of 64 bits; the words of 32 bits); the documents'
ids and lengths (64-bit each); checkpoints (three 64-bit numbers each); ``<3Q``: documents,
checkpoints, CRC-32 of the frequency table; ``MAGIC``. The folder holds the table itself and a manifest
(Parquet: name, first id's global position, documents and ids of each file), so it can be read without
anything of the session that wrote it.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import Shared, small_slices
from threadloom.session import drop_path, materialize, scratch_path

MAGIC = b"TLRANS01"
SCALE = 20
LANES = 128
STEPS = 512
TOGETHER = 32
LOW = np.uint64(1 << 31)
CHUNK_IDS = 1 << 22
CACHE_UNITS = 800_000
MOST_TASKS = 4096
TABLE = "frequencies.table"
MANIFEST = "manifest.parquet"
#: White space other than the space and the newline, and characters that only some regex engines call white space.
ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Letters and numbers below U+0250, and the byte-level pre-tokeniser's cut of texts that hold no others.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Units of these characters are cut that way; "<" may begin a special token.
PLAIN = re.compile("[\n -;=-~\xa1-\u024f]*")
#: The pre-tokeniser shows a byte that is no visible Latin-1 character as a code point from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = np.array([b if b in VISIBLE else 256 + sum(c not in VISIBLE for c in range(b)) for b in range(256)], "<u2")
SPACE = "\u0120"


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to ``2**SCALE``; every id that occurs keeps at least 1."""
    total, room = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    if int((counts > 0).sum()) > room:
        raise ValueError("more distinct ids than the table's scale can hold")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * room / total).astype(np.int64)), 0)
    order = np.argsort(-freq, kind="stable")
    rest = room - int(freq.sum())
    k = 0
    while rest:
        i = order[k % len(order)]
        step = rest if rest > 0 else -min(-rest, int(freq[i]) // 2)
        freq[i] += step
        rest -= step
        k += 1
    return freq


def encode_blocks(ids: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """Encoded blocks of a run of ids."""
    if not len(ids):
        return []
    starts = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    f_of, c_of = freq.astype(np.uint64), starts
    filler, size, out = int(np.argmax(freq)), LANES * STEPS, []
    whole = len(ids) // size
    groups = [(s * size, min(whole, s + TOGETHER) * size, STEPS) for s in range(0, whole, TOGETHER)]
    if len(ids) % size:
        groups.append((whole * size, len(ids), -(-(len(ids) % size) // LANES)))
    for a, b, steps in groups:
        blocks = -(-(b - a) // (steps * LANES))
        padded = np.full(blocks * steps * LANES, filler, np.int64)
        padded[: b - a] = ids[a:b]
        grid = padded.reshape(blocks, steps, LANES).transpose(1, 0, 2)
        state = np.full((blocks, LANES), LOW)
        words = np.empty((steps, blocks, LANES), np.uint32)
        emits = np.empty((steps, blocks, LANES), bool)
        for t in range(steps - 1, -1, -1):
            f, c = f_of[grid[t]], c_of[grid[t]]
            over = state >= (f << np.uint64(63 - SCALE))
            words[t], emits[t] = state.astype(np.uint32), over
            state = np.where(over, state >> np.uint64(32), state)
            q = state // f
            state = (q << np.uint64(SCALE)) + (state - q * f) + c
        for k in range(blocks):
            n = min(b - a - k * steps * LANES, steps * LANES)
            stream = words[:, k][emits[:, k]]
            own = ids[a + k * steps * LANES : a + k * steps * LANES + n]
            head = struct.pack("<4I", n, steps, len(stream), zlib.crc32(own.astype("<u4").tobytes()))
            out.append(head + state[k].astype("<u8").tobytes() + stream.astype("<u4").tobytes())
    return out


def decode_blocks(blocks: list[bytes], freq: np.ndarray) -> list[np.ndarray]:
    """Ids of encoded blocks; a block that fails its checksum raises."""
    starts = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    f_of, symbol = freq.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    heads = [struct.unpack_from("<4I", b) for b in blocks]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    mask = np.uint64((1 << SCALE) - 1)
    by_steps: dict[int, list[int]] = {}
    for k, h in enumerate(heads):
        by_steps.setdefault(h[1], []).append(k)
    groups = [(steps, own[s : s + TOGETHER]) for steps, own in by_steps.items() for s in range(0, len(own), TOGETHER)]
    for steps, own in groups:
        state = np.stack([np.frombuffer(blocks[k], "<u8", LANES, 16) for k in own]).astype(np.uint64)
        streams = [np.frombuffer(blocks[k], "<u4", heads[k][2], 16 + 8 * LANES) for k in own]
        words = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        at = np.cumsum([0, *map(len, streams)])[:-1]
        grid = np.empty((steps, len(own), LANES), np.int32)
        for t in range(steps):
            low = state & mask
            s = symbol[low.astype(np.int64)]
            grid[t] = s
            state = f_of[s] * (state >> np.uint64(SCALE)) + low - starts[s]
            need = state < LOW
            place = np.cumsum(need, axis=1)
            spots = (at[:, None] + place - 1)[need]
            state[need] = (state[need] << np.uint64(32)) | words[spots]
            at = at + place[:, -1]
        for j, k in enumerate(own):
            ids = grid[:, j].reshape(-1)[: heads[k][0]].astype("<u4")
            if zlib.crc32(ids.tobytes()) != heads[k][3]:
                raise ValueError("a block fails its checksum")
            out[k] = ids
    return out


def odd(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    return bool(ODD.search(text))


def shown(words: list[str]) -> list[str]:
    """Words without a space, as the byte-level pre-tokeniser shows them."""
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return SHOWN[raw].tobytes().decode("utf-16-le").split(SPACE)


class Units(dict):
    """Packed ids of the units that follow ``before``.

    Words of Latin letters, alone or before a full stop or a comma, are learned many at a time through the
    library's merge model. Other plain units are cut by the byte-level pre-tokeniser's rule, written out
    here for Latin letters; any other unit goes through the whole library.
    """

    def __init__(self, library, merger, kind: str, before: str):
        super().__init__()
        self.library, self.tokenize, self.pieces = library, merger.tokenize, {}
        self.code, self.before = "H" if kind == "<u2" else "I", before
        self.marks = {m: self.whole(m) for m in ".,"}

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def learn(self, fresh: set[str]) -> None:
        words, marked, others = [], [], []
        for u in fresh:
            body = u[:-1] if u[-1:] in self.marks else u
            if not body.isalpha() or not (body.isascii() or max(body) < "\u0250"):
                others.append(u)
            elif body is u:
                words.append(u)
            else:
                marked.append(u)
        words += {u[:-1] for u in marked}.difference(self, words)
        lead, tokenize, pack = SPACE if self.before else "", self.tokenize, self.pack
        self.update({w: pack([t.id for t in tokenize(lead + x)]) for w, x in zip(words, shown(words), strict=True)} if words else {})
        self.update({u: self[u[:-1]] + self.marks[u[-1]] for u in marked})
        self.cut(others)

    def cut(self, units: list[str]) -> None:
        found = {u: PIECE.findall(self.before + u) for u in units if PLAIN.fullmatch(self.before + u)}
        pieces, tokenize, pack = self.pieces, self.tokenize, self.pack
        fresh = sorted({p for own in found.values() for p in own}.difference(pieces))
        if fresh:
            words = shown([p.removeprefix(" ") for p in fresh])
            pieces.update({p: pack([t.id for t in tokenize(SPACE + x if p[0] == " " else x)]) for p, x in zip(fresh, words, strict=True)})
        self.update({u: b"".join([pieces[p] for p in own]) for u, own in found.items()})
        self.update({u: self.whole(self.before + u) for u in units if u not in found})


class Tokens:
    """Ids of texts by the tokenizers library, which encodes each distinct unit once.

    A byte-level pre-tokeniser never joins a character that is not white space to a space after it, so
    a text's ids are those of its units (what lies between spaces, with the space before it). Texts whose
    white space is less plain than that, and tokenizers of another kind, are encoded whole.
    """

    def __init__(self, definition: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        self.end = np.array([end_id], self.kind).tobytes()
        made = json.loads(definition)
        rule = made.get("pre_tokenizer") or {}
        ordinary = all("<" in t["content"] for t in made.get("added_tokens", []))
        self.by_unit = rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and not made.get("normalizer") and not made.get("post_processor") and ordinary
        self.merger = self.library.model
        if self.by_unit and hasattr(self.merger, "_resize_cache"):  # it sees a unit once, so its own cache would only be filled; whole texts keep theirs
            self.merger = Tokenizer.from_str(definition).model
            self.merger._resize_cache(0)
        self.units, self.firsts = Units(self.library, self.merger, self.kind, " "), Units(self.library, self.merger, self.kind, "")

    def plain(self, text: str) -> bool:
        return self.by_unit and not ("  " in text or text.endswith(" ") or "\n \n" in text or odd(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text and the end id; a null text counts as empty."""
        gc.disable()  # many small objects, none in a cycle
        try:
            return self.encode_all(texts)
        finally:
            gc.enable()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split = [t.split(" ") if t and self.plain(t) else None for t in texts]
        for units, heads in ((self.units, False), (self.firsts, True)):
            met = {w[0] for w in split if w} if heads else set().union(*(w[1:] for w in split if w))
            fresh = met.difference(units)
            if len(units) + len(fresh) > CACHE_UNITS:
                units.clear()
                units.pieces.clear()
                fresh = met
            units.learn(fresh)
        out, get = [], self.units.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append((self.units.whole(text) if text else b"") + self.end)
            else:
                parts = [self.firsts[words[0]], *map(get, words[1:]), self.end]
                out.append(b"".join(parts))
        return out


#: The last tokenizer of this process; a worker that is used for many tasks keeps its units.
_KEPT: dict[tuple[str, int], Tokens] = {}


def tokens_of(definition: str, end_id: int) -> Tokens:
    if (definition, end_id) not in _KEPT:
        _KEPT.clear()
        _KEPT[definition, end_id] = Tokens(definition, end_id)
    return _KEPT[definition, end_id]


def tokenise(docs: DataFrame, definition: str, end_id: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, check, n, ids)`` where the text lies; ``ids`` is packed (16 bits where the vocabulary allows, else 32).

    One row per input row; a null text counts as empty and has the end id alone. ``check`` is the text's CRC-32.
    """
    shared = Shared(docs.sparkSession, definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(shared.value, end_id)
        width = np.dtype(tokens.kind).itemsize
        for batch in small_slices(batches, "text"):
            blobs = tokens.encode(batch.column("text").to_pylist())
            sizes = pa.array([len(b) // width for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("check"), sizes, pa.array(blobs, pa.binary())], ["doc_id", "check", "n", "ids"])

    check = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("check")
    return docs.select("doc_id", check, "text").mapInArrow(run, "doc_id long, check long, n long, ids binary")


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over ``tokens(n, ids)``; only the vocabulary's counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in small_slices(batches, "ids"):
            sizes, blobs = batch.column("n").to_numpy(), batch.column("ids").to_pylist()
            if not sizes.sum():
                continue
            own = np.bincount(_unpack(b"".join(blobs), int(sizes.sum())))
            if len(own) < len(total):
                own, total = total, own
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = tokens.select("ids", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def save_table(freq: np.ndarray, folder: str) -> None:
    """Write the folder's frequency table: ``MAGIC``, the counts as 32-bit integers, their CRC-32."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    raw = freq.astype("<u4").tobytes()
    with system.open_output_stream(f"{base}/{TABLE}", compression=None) as out:
        out.write(MAGIC + raw + struct.pack("<I", zlib.crc32(raw)))


def load_table(system: fs.FileSystem, base: str) -> tuple[np.ndarray, int]:
    """The folder's frequency table and its checksum, which every file of the folder repeats."""
    with system.open_input_stream(f"{base}/{TABLE}", compression=None) as f:
        data = f.read()
    raw, (check,) = data[len(MAGIC) : -4], struct.unpack("<I", data[-4:])
    if data[: len(MAGIC)] != MAGIC or zlib.crc32(raw) != check:
        raise ValueError(f"{base}/{TABLE} is no frequency table")
    return np.frombuffer(raw, "<u4").astype(np.int64), check


def write_files(tokens: DataFrame, folder: str) -> DataFrame:
    """``tokens(doc_id, check, n, ids)`` -> ``(part, chunk, name, docs, ids)`` of the files written, in ascending doc_id order over (part, chunk).

    A file takes documents until ``CHUNK_IDS`` ids. A retried task writes under new names, so only files of tasks that succeeded are listed.
    """
    spark = tokens.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        freq, check = load_table(system, base)
        part, chunk, held, size = TaskContext.get().partitionId(), 0, ([], [], []), 0

        def flush() -> pa.RecordBatch:
            doc_ids, sizes, blobs = held
            name = f"{uuid.uuid4().hex}.rans"
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                write_file(out, doc_ids, sizes, np.concatenate([_unpack(b, n) for b, n in zip(blobs, sizes, strict=True)]), freq, check)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "name": [name], "docs": [len(sizes)], "ids": [size]})
            for x in held:
                x.clear()
            return row

        for batch in batches:
            for doc_id, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                if held[0] and size + n > CHUNK_IDS:
                    yield flush()
                    chunk, size = chunk + 1, 0
                size += n
                for x, v in zip(held, (doc_id, n, blob), strict=True):
                    x.append(v)
        if held[0]:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("check")]
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    return ordered.mapInArrow(run, "part int, chunk int, name string, docs long, ids long")


def write_file(out, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, freq: np.ndarray, check: int) -> None:
    out.write(MAGIC)
    offset, first, marks = len(MAGIC), 0, []
    for block in encode_blocks(ids, freq):
        out.write(block)
        marks.append((offset, first, len(block)))
        offset, first = offset + len(block), first + struct.unpack_from("<I", block)[0]
    names = np.array([-(2**63) if d is None else d for d in doc_ids], "<i8")
    out.write(names.tobytes() + np.array(sizes, "<i8").tobytes() + np.array(marks, "<i8").tobytes())
    out.write(struct.pack("<3Q", len(doc_ids), len(marks), check) + MAGIC)


def read_file(system: fs.FileSystem, path: str, freq: np.ndarray, check: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of each document of a file, decoded some blocks at a time; the file must name the table's checksum."""
    with system.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(32, size - 32)
        if tail[24:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no file of this format")
        docs, marks, own = struct.unpack_from("<3Q", tail)
        if own != check:
            raise ValueError(f"{path} was written with another frequency table")
        meta = f.read_at(16 * docs + 24 * marks, size - 32 - 16 * docs - 24 * marks)
        doc_ids, sizes = np.frombuffer(meta, "<i8", docs), np.frombuffer(meta, "<i8", docs, 8 * docs)
        points = np.frombuffer(meta, "<i8", 3 * marks, 16 * docs).reshape(-1, 3)
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(doc_ids.tolist(), sizes.tolist(), strict=True):
            while len(held) < n:
                group = points[k : k + TOGETHER]
                held = np.concatenate([held, *decode_blocks([f.read_at(int(length), int(offset)) for offset, _, length in group], freq)])
                k += TOGETHER
            yield None if doc_id == -(2**63) else doc_id, held[:n]
            held = held[n:]


def write_tokens(docs: DataFrame, definition: str, folder: str, end_id: int = 2) -> None:
    """Encode ``docs(doc_id, text)`` into files of ``folder``, with their frequency table and the manifest that gives their order.

    Documents stand in ascending doc_id order, null ids first, repeated ids by checksum of their text; rows equal
    in both are interchangeable. Extra columns are ignored; an empty table leaves a table and an empty manifest.
    """
    tokens, path = materialize(tokenise(docs, definition, end_id), "tokens")
    save_table(frequency_table(count_ids(tokens)), folder)
    written, listed = materialize(write_files(tokens, folder), "rans-files")
    totals = sorted((r.part, r.n) for r in written.groupBy("part").agg(F.sum("ids").alias("n")).collect())  # a row per partition
    before = np.r_[0, np.cumsum([n for _, n in totals])]
    bases = docs.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written.withColumn("upto", F.sum("ids").over(inside)).join(F.broadcast(bases), "part")
    placed.select("name", (F.col("base") + F.col("upto") - F.col("ids")).alias("start"), "docs", "ids").write.parquet(f"{folder}/{MANIFEST}")
    for p in (path, listed):
        drop_path(docs.sparkSession, p)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of :func:`write_tokens` -> ``(doc_id, start, n_tokens, ids_crc32)`` per document, decoded from its files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        freq, check = load_table(system, base)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found = [(d, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, ids in read_file(system, f"{base}/{name}", freq, check)]
                doc_ids, sizes, sums = zip(*found, strict=True)
                starts = start + np.r_[0, np.cumsum(sizes)[:-1]]
                columns = (pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema("name string, start long, docs long, ids long").parquet(f"{folder}/{MANIFEST}")
    count = files.count()
    return files.select("name", "start").repartition(max(1, min(count, MOST_TASKS))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, definition: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """:func:`write_tokens` into ``folder`` (a new one in the shared folder by default), then :func:`read_tokens`."""
    folder = folder or scratch_path(docs.sparkSession, "rans")
    write_tokens(docs, definition, folder, end_id)
    return read_tokens(docs.sparkSession, folder)
