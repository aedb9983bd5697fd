"""SentencePiece, token files, archives, sharding and decontamination: exact comparisons and round trips."""

import hashlib
import json
import zlib

import numpy as np
import pyarrow.fs as fs
import pytest

from threadloom.llm import decontaminate, rans, sentencepiece, sharding, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    "Hello world, the quick brown fox.", None, "", " ", "   leading and   inner  spaces ", "line\n\n \n break\r\n\ttab", "ein Wörterbuch für Größe — ça va? 日本語テキスト 🎉👩‍👩‍👧",
    "a" * 3000, "▁ the mark ▁▁ itself", "<0x41> </s> <unk> <|endoftext|>", "12345 3.14 don't we'll I'M", "x y z\u0085w \x1c q", "word " * 20_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(20 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (20, TEXTS[0])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS start", "4 AS part")


def test_sentencepiece_equals_the_library(spark, docs):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    encoder = sentencepiece.Encoder(sentencepiece.load(path))
    rng = np.random.default_rng(0)
    noise = ["".join(rng.choice(list("abtheinr ▁é<x1\n"), int(rng.integers(1, 40)))) for _ in range(3000)]
    texts = [t or "" for t in TEXTS] + noise
    got = encoder.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    encoded = sentencepiece.encode(docs, sentencepiece.load(path))
    rows = encoded.collect()
    assert len(rows) == docs.count()
    back = {(r.doc_id, r.text) for r in sentencepiece.decode(encoded, sentencepiece.load(path)).collect()}
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.exact == (r.doc_id != 12)
    assert all((20 - i, t or "") in back for i, t in enumerate(TEXTS) if i != 8)
    assert sentencepiece.encode(docs.limit(0), sentencepiece.load(path)).collect() == []


def test_unigram_viterbi_equals_enumeration():
    encoder = sentencepiece.Encoder.__new__(sentencepiece.Encoder)
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -1.2, "aba": -2.1, "bb": -4.0}
    encoder.unigram, encoder.ids = True, {p: i for i, p in enumerate(scores)}
    encoder.score, encoder.longest, encoder.least = dict(enumerate(scores.values())), 3, -20.0
    encoder.bytes, encoder.unknown, encoder.cache = None, 99, {}

    def best(word):
        if not word:
            return 0.0, []
        return max(((scores[word[:n]] + best(word[n:])[0], [encoder.ids[word[:n]], *best(word[n:])[1]]) for n in (1, 2, 3) if word[:n] in scores), key=lambda x: x[0])

    words = ["".join("ab"[k >> i & 1] for i in range(8)) for k in range(256)]
    encoder.learn(words)
    for w in words:
        assert abs(sum(encoder.score[i] for i in encoder.cache[w]) - best(w)[0]) < 1e-9
    encoder.learn(["azb"])
    assert encoder.cache["azb"] == (0, 99, 1)


def test_coder_round_trips():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 5000, rans.LANES * rans.STEPS, 3 * rans.LANES * rans.STEPS + 77):
        ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
        freq = rans.frequency_table(np.bincount(ids, minlength=5001))
        assert freq.sum() in (0, 1 << rans.SCALE)
        blocks = rans.encode_blocks(ids, freq)
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *rans.decode_blocks(blocks, freq)]), ids)
        if n > 100_000:
            assert np.array_equal(rans.decode_blocks(blocks[1:2], freq)[0], ids[rans.LANES * rans.STEPS : 2 * rans.LANES * rans.STEPS])
            entropy = -sum(c / n * np.log2(c / n) for c in np.bincount(ids) if c)
            assert sum(map(len, blocks)) * 8 / n < entropy * 1.1 + 0.2
            broken = blocks[0][:-4] + bytes(4)
            with pytest.raises(ValueError):
                rans.decode_blocks([broken if broken != blocks[0] else blocks[0][:-4] + b"abcd"], freq)


def test_one_id_only():
    freq = rans.frequency_table(np.array([0, 0, 900]))
    ids = np.full(900, 2, np.uint32)
    assert np.array_equal(rans.decode_blocks(rans.encode_blocks(ids, freq), freq)[0], ids)


def test_token_files_equal_the_library(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(rans, "CHUNK_IDS", 8000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    library = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in rans.write_and_read(docs, definition).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert rans.write_and_read(docs.limit(0), definition).collect() == []


def test_units_equal_the_library_over_all_blocks():
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    library, tokens = Tokenizer.from_str(definition), rans.Tokens(definition, 2)
    rng = np.random.default_rng(9)
    blocks = [(0x20, 0x7F), (0xA1, 0x250), *((k, k + 0x100) for k in range(0, 0x30000, 0x100) if not 0xD800 <= k < 0xE000)]
    common, texts = list("etaoin'sdl.,  \n<1-"), []
    for low, high in blocks * 2:
        letters = [chr(int(c)) for c in rng.integers(max(low, 9), high, 12)] + common
        texts.append("".join(rng.choice(letters, int(rng.integers(5, 80)))))
    texts += [" ".join("".join(rng.choice(list("abeéßçñthe'"), int(rng.integers(1, 9)))) + str(rng.choice(["", "", ".", ",", "\nAn", "'s"])) for _ in range(40)) for _ in range(300)]
    got = tokens.encode(texts)
    for text, packed in zip(texts, got, strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text


def test_a_new_process_reads_the_files(spark, docs, tmp_path):
    import subprocess
    import sys

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        rans.write_tokens(docs, f.read(), f"file://{tmp_path}/files")
    want = sorted(tuple(r) for r in rans.read_tokens(spark, f"file://{tmp_path}/files").na.fill(-1).collect())
    code = f"""
import zlib
import pyarrow.fs as fs, pyarrow.parquet as pq
from threadloom.llm import rans
system, base = fs.FileSystem.from_uri("file://{tmp_path}/files")
freq, check = rans.load_table(system, base)
rows = []
for r in pq.read_table(base + "/" + rans.MANIFEST).to_pylist():
    start = r["start"]
    for d, ids in rans.read_file(system, base + "/" + r["name"], freq, check):
        rows.append((-1 if d is None else d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
print(sorted(rows))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert eval(out.stdout) == want
    freq, check = rans.load_table(fs.LocalFileSystem(), f"{tmp_path}/files")
    name = next(x.name for x in (tmp_path / "files").iterdir() if x.suffix == ".rans")
    with pytest.raises(ValueError):
        list(rans.read_file(fs.LocalFileSystem(), f"{tmp_path}/files/{name}", freq, check + 1))


PAGES = [
    (4, "http://a/4", "x" * 150), (2, "http://a/2", "x" * 150), (9, None, "x" * 150), (3, "http://a/3", None), (5, "http://a/\r\n5", ""), (6, "u", "short"), (7, "u", "short"),
    (8, "ü", "é\r\n\r\n" * 40), (1, "u", "WARC/1.1\r\n\r\n" * 20_000), (2, "http://a/2", "x" * 150),
]


def test_archives_hold_every_page(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "1 AS refers_to", "'r' AS record_type")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        twin = len(raw) >= 100 and min(j for j, _, h in PAGES if h == html)
        again = bool(twin) and twin != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", twin if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_normaliser_makes_members_with_an_index(spark, tmp_path):
    records = [warc.write_record(i, "u", b"p" * (i * 1000), hashlib.sha256(b"p" * (i * 1000)).hexdigest(), None) for i in range(5)]
    whole = tmp_path / "whole.warc.gz"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole.write_bytes(z.compress(b"".join(records[:3])) + z.flush() + warc.gzip_member(b"".join(records[3:])))
    row = warc.normalise(spark.createDataFrame([(str(whole),)], "archive string"), f"file://{tmp_path}/out").first()
    assert row.records == 5
    raw, _ = fs.FileSystem.from_uri(f"file://{row.archive}")
    data = open(row.archive, "rb").read()
    index = [json.loads(line) for line in open(row.sidecar)]
    assert [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == records
    with pytest.raises(ValueError):
        list(warc.inflate(iter([whole.read_bytes()[:50]])))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n, 7)
    assert sorted(places.tolist()) == rows.tolist()
    assert np.array_equal(sharding.restore(places, n, 7), rows)
    if n > 500:
        assert not np.array_equal(sharding.permute(rows, n, 8), places)
        assert abs(np.corrcoef(rows, places)[0, 1]) < 0.15


def test_shards_are_even_and_reproducible(spark):
    rows = [(i * 3, f"text {i % 7}") for i in range(997)] + [(None, None), (None, "x"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS shard", "1 AS row", "2 AS size")
    got = sharding.shard(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(df.repartition(7)).collect()))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(6, zlib.crc32(b"again")), (7, zlib.crc32(b"text 1"))}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0), (2, zlib.crc32(b"x"))}
    assert sharding.shard(df.limit(0)).collect() == []


def brute_overlap(text, item, similarity, least):
    best = 0
    for shift in range(-len(item), len(text)):
        run = [text[k] == item[k - shift] for k in range(max(0, shift), min(len(text), shift + len(item)))]
        for a in range(len(run)):
            for b in range(a + 1, len(run) + 1):
                if sum(run[a:b]) >= similarity * (b - a) - 1e-9:
                    best = max(best, sum(run[a:b]))
    return best


def test_decontamination_finds_substituted_passages(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    item = [str(rng.choice(words)) for _ in range(30)]
    bench = [(1, " ".join(item)), (2, "alpha beta gamma delta epsilon zeta"), (3, "too short"), (4, None), (5, ""), (None, " ".join(item[::-1]))]
    noise = lambda n: [str(rng.choice(words)) for _ in range(n)]
    swapped = [w if k % 6 else "other" for k, w in enumerate(item)]
    rows = [
        (10, " ".join(noise(20) + item + noise(20))), (11, " ".join(noise(5) + swapped + noise(5)).upper()), (12, " ".join(noise(200))), (13, None), (14, ""),
        (15, "x alpha, beta gamma delta epsilon ZETA y"), (16, " ".join(item[:5] + noise(10))), (17, " ".join(noise(9000) + item[4:26] + noise(9000))), (10, " ".join(item)), (18, "too short"),
        (19, " ".join(w if k % 2 else "odd" for k, w in enumerate(item))), (None, " ".join(item[::-1])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS first_word")
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "5 AS doc_id")
    got = decontaminate.find_overlaps(df, b).collect()
    pairs = sorted(((r.doc_id or 0, r.item_id) for r in got), key=str)
    assert pairs == [(0, None), (10, 1), (10, 1), (11, 1), (15, 2), (17, 1)]
    for r in got:
        assert r.matched_words >= 0.8 * r.n_words - 1e-9
        if r.doc_id in (10, 11):
            texts = [t for d, t in rows if d == r.doc_id]
            assert r.matched_words in [brute_overlap(t.lower().split(), item, 0.8, 10) for t in texts]
    kept = decontaminate.keep_uncontaminated(df, b)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 16, 18, 19]
    assert decontaminate.find_overlaps(df, b.limit(0)).collect() == [] and decontaminate.find_overlaps(df.limit(0), b).collect() == []
    assert kept.count() == 6 and decontaminate.keep_uncontaminated(df, b.limit(0)).count() == len(rows)


def test_benchmark_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    bench = spark.createDataFrame([(k, " ".join(f"t{k}x{j}" for j in range(20))) for k in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "lead in " + " ".join(f"t{k}x{j}" for j in range(20))) for k in range(14)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench).collect()) == [(k, k) for k in range(12)]
    assert sorted(r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench).collect()) == [12, 13]
