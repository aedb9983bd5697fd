"""SentencePiece encoding and decoding by a Viterbi pass that words share along their prefixes.

A text is cut into marked words (the space mark and what follows). The distinct marked words of a
batch are sorted, which lays them out as a trie in depth-first order: the forward states of the
prefix a word shares with its predecessor are kept and only the rest is computed.

For unigram models the forward score of a prefix is its best sum of piece scores. For BPE models a
step from one piece to the next scores 0 if merging in priority order would leave the border between
the two alone and minus infinity if it would not; exactly one path survives at every prefix, and it
is the segmentation that the merges give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.shared import Shared, lean, small_slices

MARK = "▁"
CACHE_WORDS = 300_000
CACHE_LETTERS = 6_000_000
CACHE_BORDERS = 100_000
NEVER = float("inf")


class Encoder:
    """Encodes and decodes with the pieces of one model file; models that rewrite characters are refused."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(model)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that normalise text are not supported")
        self.unigram = spec.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        sp = SentencePieceProcessor(model_proto=model)
        names = [sp.IdToPiece(i) for i in range(sp.GetPieceSize())]
        plain = [i for i in range(len(names)) if not (sp.IsByte(i) or sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {i: sp.GetScore(i) for i in plain}
        self.unknown = sp.unk_id()
        self.bytes = [sp.PieceToId(f"<0x{b:02X}>") for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.longest = max(map(len, self.ids), default=1)
        self.raw = [n.replace(MARK, " ").encode() for n in names]
        for i, n in enumerate(names):
            if sp.IsByte(i):
                self.raw[i] = bytes([int(n[3:5], 16)])
            elif sp.IsControl(i):
                self.raw[i] = b""
        if sp.IsUnknown(self.unknown):
            self.raw[self.unknown] = " ⁇ ".encode()
        inner = any(MARK in n[1:] and n.strip(MARK) for n in self.ids) or any(n[-1:] == MARK and n.strip(MARK) for n in self.ids)
        breaks = "" if any("\n" in n for n in self.ids) else "\n"
        lone = "\n|" if breaks else ""
        self.words = re.compile(rf"{lone}{MARK}*[^{MARK}{breaks}]+|{MARK}+", re.S) if not inner else re.compile(r".+", re.S)
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.trees: dict[str, tuple | None] = {}
        self.borders: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.letters = 0  # of the cached words

    def tree(self, piece: str) -> tuple | None:
        """(rank, left part, right part) of the merge that makes ``piece``; () for one character; None if merges never make it."""
        if piece not in self.trees:
            parts = list(piece)
            last: tuple | None = ()
            while len(parts) > 1:
                ranks = [(-self.score[i] if (i := self.ids.get(a + b)) is not None else NEVER) for a, b in zip(parts, parts[1:], strict=False)]
                k = ranks.index(min(ranks))
                if ranks[k] == NEVER:
                    last = None
                    break
                last = (ranks[k], parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.trees[piece] = last
        return self.trees[piece]

    def stands(self, left: str, right: str) -> bool:
        """Whether no merge would have crossed the border between two neighbouring pieces.

        Walks back through the pieces at the border, undoing the later merge first: a crossing merge
        would win if it came before the merge that its left part went into, and not after that of its right part.
        """
        key = (left, right)
        if key in self.borders:
            return self.borders[key]
        a, b, until_a, until_b, fine = left, right, NEVER, NEVER, True
        while True:
            if (i := self.ids.get(a + b)) is not None:
                rank = -self.score[i]
                if rank < until_a and rank <= until_b:
                    fine = False
                    break
            ta, tb = self.tree(a), self.tree(b)
            if ta is None or tb is None:
                fine = False
                break
            if not ta and not tb:
                break
            if tb and (not ta or tb[0] >= ta[0]):
                until_b, b = tb[0], tb[1]
            else:
                until_a, a = ta[0], ta[2]
        self.borders[key] = fine
        return fine

    def _step(self, word: str, at: int, pieces: list, scores: list) -> None:
        """Extend the forward states of ``word[:at - 1]`` to ``word[:at]``."""
        ids, best, found = self.ids, -NEVER, ""
        for size in range(1, min(self.longest, at) + 1):
            piece = word[at - size : at]
            i = ids.get(piece)
            if i is None and size > 1:
                continue
            before = scores[at - size]
            if before == -NEVER:
                continue
            if self.unigram:
                score = before + (self.score[i] if i is not None else self.least)
            elif i is not None and (self.tree(piece) is None or (at > size and not self.stands(pieces[at - size], piece))):
                continue
            else:
                score = 0.0
            if score > best:
                best, found = score, piece
                if not self.unigram:
                    break
        pieces.append(found)
        scores.append(best)

    def learn(self, words: list[str]) -> None:
        """Encode distinct marked words in trie order into the cache."""
        pieces, scores, previous = [""], [0.0], ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(previous, word, strict=False):
                if x != y:
                    break
                shared += 1
            del pieces[shared + 1 :], scores[shared + 1 :]
            for at in range(shared + 1, len(word) + 1):
                self._step(word, at, pieces, scores)
            previous, at, path = word, len(word), []
            while at:
                path.append(pieces[at])
                at -= len(pieces[at])
            out: list[int] = []
            for piece in reversed(path):
                i = self.ids.get(piece)
                out.extend([i] if i is not None else [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown])
            self.cache[word] = tuple(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null or empty text has none."""
        seen: dict[str, str] = {}  # one string per distinct word, however often the texts hold it
        split = [[seen.setdefault(w, w) for w in self.words.findall((MARK if self.prefix else "") + t.replace(" ", MARK))] if t else [] for t in texts]
        fresh = seen.keys() - self.cache.keys()
        self.letters += sum(map(len, fresh))
        if len(self.cache) + len(fresh) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.cache = {w: self.cache[w] for w in seen.keys() & self.cache.keys()}  # words that come again stay
            self.letters = sum(map(len, seen))
        if len(self.borders) > CACHE_BORDERS:
            self.borders.clear()
        self.learn(list(fresh))
        ids_of = self.cache.__getitem__
        return [np.fromiter(chain.from_iterable(map(ids_of, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load(path: str) -> bytes:
    """The model file's bytes, as the functions below take them."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_tokens, ids_crc32, exact, ids)``; one row per input row.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``exact`` tells whether
    decoding gives the text back (it doesn't where a text holds the space mark itself). Null and empty
    texts have no ids; a null counts as empty. Extra columns are ignored.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in small_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids = encoder.encode(texts)
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([encoder.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "exact", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long, exact boolean, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded(doc_id, ids)`` -> ``(doc_id, text)``; null ids give an empty text."""
    shared = Shared(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in small_slices(batches, "ids"):
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
