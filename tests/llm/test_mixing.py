"""Mixing against a plain version: targets by repeated sharing, then sorted keys and running sums."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import mixing

DOCS = "doc_id long, text string, source string, size long, target string, _row int"


def plain_targets(words, share=1.5, weights=(5, 2, 1), most=2):
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(words.values()), list(order)
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * words[s]]
        for s in over:
            target[s] = float(most * words[s])
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        free = [s for s in free if s not in over]
        left -= sum(target[s] for s in over)
    return target


def plain(docs, labels):
    rated = defaultdict(list)
    for doc_id, quality in labels:
        if doc_id is not None and quality is not None:
            rated[doc_id].append(quality)
    rows, words = defaultdict(list), Counter()
    for doc_id, text, source in docs:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        h = hashlib.md5(f"0-{'' if doc_id is None else doc_id}-{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        weight = 0.5 + 1.5 * np.mean(rated[doc_id]) if doc_id in rated else 1.0
        rows[source].append((-math.log((int(h[:13], 16) + 0.5) / 2**52) / weight, int(h[13:28], 16), doc_id, size))
        words[source] += size
    target, out = plain_targets(words), []
    for source, held in rows.items():
        epochs = int(target[source] // words[source]) if words[source] else 0
        budget, ahead = target[source] - epochs * words[source], 0
        for _, _, doc_id, size in sorted(held, key=lambda r: r[:2]):
            out.append((doc_id, size, words[source], round(target[source], 4), size * (epochs + (ahead + size / 2 <= budget))))
            ahead += size
    return sorted(map(str, out))


def mixed(spark, docs, labels=None):
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS)
    return mixing.mix(table, spark.createDataFrame(labels, "doc_id long, quality int") if labels is not None else None)


def shown(df):
    return sorted(str((*r[:3], round(r[3], 4), r[4])) for r in map(tuple, df.collect()))


def made(seed=2, n=500):
    rng = np.random.default_rng(seed)
    sources = ["b", "a", "É", "z", None, "", "A", "tiny"]
    docs = [(k, "w " * int(rng.integers(0, 60)) + "\x0bé x", sources[int(rng.choice(8, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.04, 0.01]))]) for k in range(n)]
    docs += [(None, None, "a"), (None, None, "a"), (7, "another text", "b"), (8, "", "z"), (900, None, "nothing"), (901, "long " * 30_000, "z"), (902, " no break", None)]
    return docs + [(None, "equal rows", "b")] * 30 + [(903, "copy", "A")] * 20, [(k, int(rng.integers(2))) for k in range(0, n, 3)] + [(7, 1), (7, 0), (None, 1), (9, None)]


def test_equals_plain_version(spark):
    docs, labels = made()
    assert shown(mixed(spark, docs, labels)) == plain(docs, labels)
    assert shown(mixed(spark, docs)) == plain(docs, [])


def test_reruns_and_other_partitions_agree(spark):
    docs, labels = made(3)
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    assert shown(mixing.mix(table, marks)) == shown(mixing.mix(table.repartition(11), marks.repartition(5)))


def test_sources_come_near_their_targets(spark):
    docs = [d for d in made(4, 2000)[0] if d[0] is not None and d[1] != "another text"]
    docs = list({d[0]: d for d in docs}.values())
    source = {d[0]: d[2] for d in docs}
    taken, target, longest = Counter(), {}, Counter()
    for r in mixed(spark, docs, []).collect():
        assert r.taken in (0, r.size, 2 * r.size)
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s], longest[s] = r.target, max(longest[s], r.size)
    assert len(target) == 9 and all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in target)


def test_better_documents_are_taken_more_often(spark):
    docs = [(k, "w " * 10, "s") for k in range(3000)] + [(5000, "w " * 100_000, "a")]
    rows = mixed(spark, docs, [(k, int(k < 1500)) for k in range(3000)]).where("doc_id < 3000").collect()
    target = rows[0].target / 30_000
    extra = [r.taken > r.size * int(target) for r in sorted(rows)]
    assert 0 < target % 1 and np.mean(extra[:1500]) > np.mean(extra[1500:]) + 0.1


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(1, "a", "s")], [(1, "", "a"), (2, "x y", "b")]])
def test_small_tables(spark, docs):
    assert shown(mixed(spark, docs, [])) == plain(docs, [])
