"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 bytes of the whole text, every letter, digit, mark and space of
it, and labels every position; a document's probabilities are the mean over its positions. Texts are cut
into chunks of ``CHUNK`` positions that are evaluated side by side; ``CONTEXT`` bytes on either side of a
chunk are read too, and only warm up the states. Gates and candidates are squashed by ``x / (1 + |x|)``, which costs
a quarter of a hyperbolic tangent. Training is backpropagation through time in numpy on windows drawn from a bounded
sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Shared, held_out, lean, small_slices

CHUNK = 168
CONTEXT = 12
ROWS = 1024
PAD = 256
SIZES = (4, 8, 16, 48)
WINDOWS = 24


@dataclass
class Tagger:
    """Weights of both directions (input table, recurrent matrix) and of the output layer."""

    langs: list[str]
    table: np.ndarray  # direction, byte, 3 * hidden: update, reset and candidate gates
    recur: np.ndarray  # direction, hidden, 3 * hidden
    out: np.ndarray  # 2 * hidden, langs
    bias: np.ndarray


def new_tagger(langs: list[str], hidden: int, seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
    return Tagger(langs, scale(2, 256, 3 * hidden), scale(2, hidden, 3 * hidden), scale(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def _squash(x: np.ndarray) -> np.ndarray:
    """To -1 .. 1; its slope at a result y is ``(1 - |y|) ** 2``."""
    return x / (1 + np.abs(x))


def forward(m: Tagger, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """``spans[row, position]`` bytes of one length -> probabilities ``[position, row, lang]``, states, and what training needs of each step."""
    rows, length = spans.shape
    hidden = m.recur.shape[1]
    both, saved = np.empty((length, rows, 2 * hidden), m.table.dtype), []
    for d in range(2):
        h = np.zeros((rows, hidden), m.table.dtype)
        for t in range(length) if d == 0 else reversed(range(length)):
            x, u = m.table[d][spans[:, t]], h @ m.recur[d]
            gates = 0.5 + 0.5 * _squash(x[:, : 2 * hidden] + u[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            un = u[:, 2 * hidden :]
            n = _squash(x[:, 2 * hidden :] + r * un)
            saved.append((d, t, h, z, r, n, un))
            h = (1 - z) * n + z * h
            both[t, :, d * hidden : (d + 1) * hidden] = h
    logits = both @ m.out + m.bias
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True), both, saved


def gradients(m: Tagger, spans: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean position cross-entropy and its gradients by backpropagation through time."""
    p, both, saved = forward(m, spans)
    length, rows, _ = p.shape
    hidden = m.recur.shape[1]
    loss = float(-np.log(p[:, np.arange(rows), labels] + 1e-9).mean())
    p[:, np.arange(rows), labels] -= 1
    p /= length * rows
    g_table, g_recur = np.zeros_like(m.table), np.zeros_like(m.recur)
    g_out, g_bias = np.tensordot(both, p, axes=([0, 1], [0, 1])), p.sum(axis=(0, 1))
    g_both = p @ m.out.T
    carry, direction, steps = None, None, np.empty((rows, length, 3 * hidden), m.table.dtype)
    for d, t, h, z, r, n, un in reversed(saved):
        if d != direction:
            carry, direction = np.zeros((rows, hidden), m.table.dtype), d
        g = g_both[t, :, d * hidden : (d + 1) * hidden] + carry
        gn = g * (1 - z) * (1 - np.abs(n)) ** 2
        gz = g * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        gr = gn * un * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        steps[:, t] = np.concatenate([gz, gr, gn], axis=1)
        through = np.concatenate([gz, gr, gn * r], axis=1)
        carry = g * z + through @ m.recur[d].T
        g_recur[d] += h.T @ through
        if t == (length - 1 if d else 0):  # the direction's last step: sum its table gradients by byte
            order = np.argsort(spans, axis=None, kind="stable")
            found, starts = np.unique(spans.reshape(-1)[order], return_index=True)
            g_table[d][found] = np.add.reduceat(steps.reshape(-1, 3 * hidden)[order], starts, axis=0)
    return loss, [g_table, g_recur, g_out, g_bias]


def train(windows: list[tuple[bytes, str]], hidden: int = 16, steps: int = 600, rows: int = 256, seed: int = 8) -> Tagger:
    """Fit on ``(bytes, lang)`` windows; a minibatch holds windows of one length, lengths drawn by the root of their counts."""
    langs = sorted({lang for _, lang in windows})
    m = new_tagger(langs, hidden, seed)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for raw, lang in sorted(windows):
        by_length.setdefault(len(raw), []).append((raw, langs.index(lang)))
    if not by_length or len(langs) < 2:
        return m
    lengths = sorted(by_length)
    pools = {k: (np.frombuffer(b"".join(raw for raw, _ in v), np.uint8).reshape(-1, k), np.array([lang for _, lang in v])) for k, v in by_length.items()}
    share = np.array([len(by_length[k]) ** 0.5 for k in lengths])
    rng = np.random.default_rng(seed)
    params = [m.table, m.recur, m.out, m.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        spans, labels = pools[lengths[int(rng.choice(len(lengths), p=share / share.sum()))]]
        at = rng.integers(0, len(labels), rows)
        _, grads = gradients(m, spans[at], labels[at])
        rate = 0.03 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


class Reader:
    """A tagger's weights laid out for evaluation; the padding byte leaves a zero state as it is."""

    def __init__(self, m: Tagger):
        k = m.recur.shape[1]
        pad = np.r_[np.full(k, 1e30), np.zeros(2 * k)].astype(np.float32)  # an update gate of exactly 1 keeps the state
        tables = np.concatenate([m.table, np.tile(pad, (2, 1, 1))], axis=1)
        self.gates, self.states = np.ascontiguousarray(tables[:, :, : 2 * k]), np.ascontiguousarray(tables[:, :, 2 * k :])
        self.to_gates, self.to_states = np.ascontiguousarray(m.recur[:, :, : 2 * k]), np.ascontiguousarray(m.recur[:, :, 2 * k :])
        self.out, self.bias, self.hidden = np.ascontiguousarray(m.out.reshape(2, k, -1).transpose(0, 2, 1)), m.bias, k

    def probabilities(self, grid: np.ndarray) -> np.ndarray:
        """``grid[row, position]`` bytes or ``PAD`` -> probabilities ``[position, lang, row]``; rows come last, so that sums over languages run along them."""
        rows, length = grid.shape
        k, columns = self.hidden, np.ascontiguousarray(grid.T, np.intp)
        logits = np.empty((length, len(self.bias), rows), np.float32)
        logits[:] = self.bias[:, None]
        g, g_work = np.empty((2, rows, 2 * k), np.float32)
        n, n_work = np.empty((2, rows, k), np.float32)
        for d in range(2):
            h = np.zeros((rows, k), np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                np.matmul(h, self.to_gates[d], out=g)
                g += np.take(self.gates[d], columns[t], axis=0, out=g_work, mode="clip")
                np.abs(g, out=g_work)
                g_work += 1
                g /= g_work
                g += 1
                g *= 0.5
                np.matmul(h, self.to_states[d], out=n)
                n *= g[:, k:]
                n += np.take(self.states[d], columns[t], axis=0, out=n_work, mode="clip")
                np.abs(n, out=n_work)
                n_work += 1
                n /= n_work
                h -= n
                h *= g[:, :k]
                h += n
                logits[t] += self.out[d] @ h.T
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits


def chunks_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk of texts of these byte sizes: its text, where it starts to read, where it starts to count, and its end of reading."""
    count = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), count)
    own = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * CHUNK
    return text, np.maximum(own - CONTEXT, 0), own, np.minimum(own + CHUNK + CONTEXT, sizes[text])


def pooled(reader: Reader, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; zeros for an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(reader.bias)))
    if not sizes.sum():
        return total
    flat, base = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
    text, read, own, end = chunks_of(sizes)
    order = np.argsort(read - end, kind="stable")  # longest first, so that a group is padded little
    for s in range(0, len(order), ROWS):
        at = order[s : s + ROWS]
        width = int((end[at] - read[at]).max())
        place = read[at][:, None] + np.arange(width)[None, :]
        inside = place < end[at][:, None]
        grid = np.where(inside, flat[np.where(inside, base[text[at]][:, None] + place, 0)].astype(np.intp), PAD)
        counted = inside & (place >= own[at][:, None]) & (place < own[at][:, None] + CHUNK)
        p = reader.probabilities(grid)
        p *= counted.T[:, None, :]
        np.add.at(total, text[at], p.sum(axis=0).T)
    return total / np.maximum(sizes, 1)[:, None]


def windows_of(text: str) -> list[bytes]:
    """Windows of ``SIZES`` bytes at places that the text's checksum draws: up to ``WINDOWS`` of the longest, one of each other size it fills."""
    raw = text.lower().encode("utf-8", "replace")
    rng, out = np.random.default_rng(zlib.crc32(raw)), []
    for size in SIZES:
        if len(raw) >= size:
            count = min(WINDOWS, 1 + len(raw) // size) if size == SIZES[-1] else 1
            out += [raw[k : k + size] for k in rng.integers(0, len(raw) - size + 1, count).tolist()]
    return out


def fit(docs: DataFrame, fit_docs: int = 1500, **options) -> Tagger | None:
    """Train on windows of about ``fit_docs`` labelled documents outside the held-out fifth, chosen by the hash of their ids.

    Every such row counts, rows that repeat an id too, whatever their languages; where ids repeat so often that the windows are over twice
    as many as ``fit_docs`` documents give, those with the smallest hashes are taken. None if no row can be learned from.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und") & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    total = usable.count()
    part = int(min(1.0, fit_docs / max(total, 1)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if own := windows_of(text):
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([lang] * len(own), pa.string())], ["window", "lang"])

    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < part).select("text", "lang")
    most = 2 * fit_docs * (WINDOWS + len(SIZES))
    rows = chosen.mapInArrow(lean(run), "window binary, lang string").orderBy(F.xxhash64("window", "lang"), "window", "lang").limit(most).collect()
    return train([(bytes(r.window), r.lang) for r in rows], **options) if rows else None


def _scorer(docs: DataFrame, model: Tagger | None):
    shared = Shared(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
        m = shared.value
        reader = Reader(m) if m else None
        for batch in small_slices(batches, "text", most_bytes=4 << 20):
            texts = batch.column("text").to_pylist()
            lettered = np.array([bool(m and t and any(map(str.isalpha, t))) for t in texts], bool)
            p = pooled(reader, [t.lower().encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, lettered, strict=True)]) if m else np.zeros((len(texts), 1))
            langs = [m.langs[k] if ok else "und" for k, ok in zip(p.argmax(axis=1), lettered, strict=True)]
            yield batch, langs, np.where(lettered, np.clip(p.max(axis=1), 0, 1), 0.0)

    return score


def predict(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, lang_pred, score)``, one row per input row.

    Null texts and texts without a letter (Unicode category L) give ``und`` with score 0, as does everything
    when nothing could be learned. Extra columns are ignored; repeated rows are all scored.
    """
    score = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, scores in score(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Tagger | None, min_score: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a letter and whose language is clear (mean probability of ``min_score`` or more).

    Null and letterless texts go; repeated rows are judged alike; an empty table stays empty.
    """
    score = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, scores in score(batches):
            yield batch.filter(pa.array([lang != "und" and s >= min_score for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
