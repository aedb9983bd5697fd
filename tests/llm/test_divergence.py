"""Source divergence against a plain version in Python integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, info string, _rows int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]


def plain(docs, least=10, most=10):
    held, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        found = Counter(terms(text or ""))
        held[lang or "", source or ""].update(found)
        seen[lang or ""].update(found.keys())
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        counts = {s: [held[lang, s][t] for t in kept] for s in sources}
        counts[None] = [sum(c[k] for c in counts.values()) for k in range(len(kept))]
        shares = {s: [1 + 10**9 * (n + 2) // (sum(c) + 2 * len(kept)) for n in c] for s, c in counts.items()}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(x, sum(map(gap, shares[s], shares[x]))) for x in sources if x != s]
            far = [(t, gap(p, q)) for t, n, p, q in zip(kept, counts[s], shares[s], shares[None]) if n and p > q]
            for part, rows, k in (("pair", pairs, len(pairs)), ("term", far, most)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(rows[:k], 1)]
    return sorted(out)


def audited(spark, docs, **kwargs):
    rows = [(k, *d, "x", 7, "y", 1) for k, d in enumerate(docs)]
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), **kwargs).collect())


def made(seed=5, n=400):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "日本", "don't", "x1y", "naïve", "Straße", "ÉTÉ"] + [f"w{chr(97 + k)}" for k in range(20)]
    odds = rng.dirichlet(np.ones(len(words)) / 3, 7)
    docs = []
    for _ in range(n):
        s = int(rng.integers(7))
        text = "".join(w + str(rng.choice([" ", "-", "9", "\n", "\x00", "…"])) for w in rng.choice(words, int(rng.integers(1, 30)), p=odds[s]))
        docs.append((text, ["en", "fr", None, ""][int(rng.integers(4))], [*"abcdef", None][s]))
    return docs


def test_equals_plain_version(spark):
    docs = made()
    docs += [(None, "en", "a"), ("", "zz", "lone"), (None, None, None), ("1 2 3", "zz", "other"), ("rare words only", "fr", "a"), ("Hot " * 50_000 + "é" * 5000, "en", "hot")]
    docs += [("copy of wording", "en", "hot")] * 40
    assert audited(spark, docs) == plain(docs)


def test_blocks_and_chunks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 10)
    monkeypatch.setattr(divergence, "CHUNK_SOURCES", 2)
    docs = made(6)
    assert audited(spark, docs, least_docs=3, most_terms=4) == plain(docs, 3, 4)


def test_equal_values_rank_by_item(spark):
    docs = [("one two three", "en", s) for s in "abc" for _ in range(10)] + [("one extra", "en", "d")] * 10
    got = audited(spark, docs)
    assert got == plain(docs) and [r[3] for r in got if r[1] == "d" and r[2] == "pair"] == ["a", "b", "c"]


def test_no_kept_term_gives_zero(spark):
    assert audited(spark, [("a b", "en", "x"), ("c d", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_slices_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh64_intdigest", lambda data, seed: len(data) % 2)
    low = b"ab cd ab efgh cd a a"
    starts, ends = divergence.boundaries(np.frombuffer(low, np.uint8), np.array([0, len(low)]))
    first, group = divergence.grouped(low, starts, ends)
    words = low.split()
    assert [words.index(w) for w in words] == [words.index(low[starts[k] : ends[k]]) for k in first[group]]


def test_no_term_crosses_a_text(spark):
    docs = [("foo", "en", "a"), ("bar", "en", "a"), ("", "en", "a"), ("baz", "en", "a")] * 10
    assert {r[3] for r in audited(spark, docs + [("foobar", "en", "b")] * 10) if r[2] == "term" and r[1] == "a"} == {"foo", "bar", "baz"}


@pytest.mark.parametrize("n, total, v", [(0, 0, 1), (10**10, 10**12, 10**9), (5, 5, 1), (9 * 10**15, 9 * 10**16, 10**10)])
def test_shares_are_exact(spark, n, total, v):
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)
