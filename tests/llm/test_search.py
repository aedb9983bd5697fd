"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import search

DOCS, ITEMS = "doc_id long, text string, n long, score long", "item_id long, text string, rank int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain(docs, items, k=20):
    bags = [(doc_id, Counter(terms(t))) for doc_id, t in docs if terms(t)]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if lost else doc_id, -s) for rank, (s, lost, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def found(spark, docs, items, k=20):
    got = search.search(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS), spark.createDataFrame([(*i, 3) for i in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


def made(seed=3, n=600):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(150)] + ["Été", "日本", "ÄB"]
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda size: "".join(w + str(rng.choice([" ", "-", ".", "\n", "_"])) for w in rng.choice(words, size, p=odds / odds.sum()))
    docs = [(k, text(int(rng.integers(1, 60)))) for k in range(n)]
    return docs, [(k, text(int(rng.integers(1, 25)))) for k in range(25)]


def odd(docs, items):
    docs = docs + [(1000 + k, "w3 w4 copied w90") for k in range(60)] + [(5, "w3 again"), (None, "w3 w4 copied w90"), (None, "w7"), (2000, None), (2001, ""), (2002, " .\n"), (2003, "W3 w140 " * 20_000)]
    items = items + [(100, None), (101, ""), (102, "unheard"), (103, "w3 copied w3 w3"), (103, "w3 copied w3 w3"), (None, "w140"), (104, "W3! w4?")]
    return docs, items


def test_equals_scoring_everything(spark):
    docs, items = odd(*made())
    assert found(spark, docs, items) == plain(docs, items)


def test_small_chunks_blocks_and_depths_change_nothing(spark, monkeypatch):
    for name, value in (("CHUNK_POSTINGS", 300), ("BLOCK_TERMS", 40), ("FIRST_DEPTH", 1)):
        monkeypatch.setattr(search, name, value)
    docs, items = odd(*made(4, 300))
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


def test_ties_go_to_smaller_ids_and_null_last(spark):
    docs = [(k, "same words here") for k in range(49, -1, -1)] + [(None, "same words here"), (None, "other"), (90, "other"), (91, "nothing")]
    assert found(spark, docs, [(1, "words"), (2, "other")]) == plain(docs, [(1, "words"), (2, "other")])


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b"), (2, "c")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == plain(docs, items) == []


def test_the_threshold_stops_early():
    rng = np.random.default_rng(1)
    n, width = 5000, 4
    times = np.repeat(rng.zipf(1.5, n).clip(1, 50), width) + rng.integers(0, 3, n * width)
    index = search.Index(rng.integers(10, 5000, n), np.full(n, width), np.tile(np.arange(width), n), times, np.full(width, 3000), n, n * 2500)
    docs, scores = index.best(0, np.arange(width), np.ones(width, np.int64), 10, 0)
    everything = index.impacts.reshape(n, width).sum(axis=1)
    want = np.lexsort((np.arange(n), -everything))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == everything[want].tolist()
    assert (index.stamps == 0).sum() < n / 2
