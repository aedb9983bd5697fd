"""SimHash groups and embedding links against brute force, with nulls, ties, repeats and hot groups."""

import numpy as np
import xxhash

from threadloom.llm import embeddings, shared, simhash

LONG = "w " * 60_000
DOCS = [
    (5, "alpha beta gamma delta epsilon zeta"),
    (3, "ALPHA beta\tgamma delta epsilon  zeta"),
    (9, None),
    (8, ""),
    (7, " \n "),
    (2, "one two"),
    (2, "one two"),
    (1, LONG),
    (None, "no id here at all"),
    (4, "Äpfel und Birnen im Garten des Nachbarn"),
    (6, "äpfel und Birnen im Garten des Nachbarn"),
]


def brute(rows, shingle, bits):
    def fp(text):
        words = [w for w in (text or "").encode().lower().split()]
        if not words:
            return 0
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    prints = [(d, fp(t)) for d, t in rows]
    out = []
    for d, f in prints:
        group, grown = {f}, True
        while grown:
            grown = {g for _, g in prints if g not in group and any((g ^ h).bit_count() <= bits for h in group)}
            group |= grown
        ids = [i for i, g in prints if g in group and i is not None]
        out.append((d, f, min(ids) if ids else None))
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "1 AS fp", "'x' AS component", "2 AS unit") if extra else df


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_groups_equal_brute_force(spark):
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, DOCS)).collect()]
    assert sorted(got, key=key) == sorted(brute(DOCS, 4, 4), key=key)


def test_random_near_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.array([base[int(rng.integers(40))] ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False)) for _ in range(400)], dtype=np.uint64)
    fps = np.unique(np.r_[base, flips])
    links = simhash.near_links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), 4).collect()
    root = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        assert ((r.src ^ r.dst) % 2**64).bit_count() <= 4
        root[find(r.src)] = find(r.dst)
    for i, f in enumerate(fps):
        for g in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ f) <= 4]:
            assert find(int(np.int64(f.view(np.int64)))) == find(int(g.view(np.int64)))


def test_hot_units_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNIT_ROWS", 8)
    near = [(1 << a) | (1 << b) for a in range(10) for b in range(a)]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in near], "fp long"), 4).collect()
    seen, todo = {near[0]}, [near[0]]
    while todo:
        x = todo.pop()
        for r in links:
            for a, b in ((r.src, r.dst), (r.dst, r.src)):
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
    assert seen == set(near)


def test_one_document_stays_of_each_group(spark):
    rows = [*DOCS, (None, "word " * 40), (None, "word " * 40), (77, "word " * 39), (2, "quite another text under an id that is there already")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "7 AS _key", "1 AS copies", "2 AS row", "3 AS name", "4 AS k", "5 AS _rows", "named_struct('a', 1) AS extra", "map('a', 1) AS m")
    kept = simhash.keep_first(df, shingle=5)
    assert kept.dtypes == df.dtypes
    got = kept.collect()
    assert all(r._key == 7 and r.source == "s" and r.k == 4 and r.extra.a == 1 for r in got)
    texts = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in got))
    assert texts == [(False, 1, "w w w w w"), (False, 2, "one two"), (False, 2, "quite ano"), (False, 3, "ALPHA bet"), (False, 4, "Äpfel und"), (False, 6, "äpfel und"), (False, 7, " \n "), (False, 77, "word word"), (True, 0, "no id her")]
    lone = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, None)], "doc_id long, text string")
    assert sorted(r.text or "" for r in simhash.keep_first(lone).collect()) == ["", "x y z"]
    assert simhash.keep_first(lone.limit(0)).collect() == []


def test_rows_equal_in_id_and_text_leave_one(spark):
    df = spark.createDataFrame([(1, "same text", k) for k in (3, 1, 2)], "doc_id long, text string, n int")
    first = simhash.keep_first(df).collect()
    assert len(first) == 1 and first == simhash.keep_first(df.orderBy("n").repartition(3)).collect()


def test_hot_hashes_meet_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNIT_ROWS", 8)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    rows = [(k, " ".join([*base, *(f"x{k}y{j}" for j in range(4))])) for k in range(120)]
    rows += [(1000 + k, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 60))) for k in range(30)]
    found = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[k] for k in range(120)} == {0} and all(found[1000 + k] == 1000 + k for k in range(30))


def test_long_texts_take_bounded_memory():
    text = b" ".join(b"w%d" % (k % 700_000) for k in range(1_000_000))
    assert len(text) > 6 << 20
    h = simhash.shingle_hashes(text, 4)
    ones = np.zeros(64, np.int64)
    for b in range(64):
        ones[b] = int(((h >> np.uint64(b)) & np.uint64(1)).sum())
    assert simhash.simhash64(text, 4) == sum(1 << b for b in range(64) if ones[b] * 2 > len(h))


def test_empty_tables(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def brute_vectors(rows, least):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    near = lambda a, b: len(a) == len(b) and float(a @ b) >= least
    out = []
    for k, (i, _) in enumerate(rows):
        group, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in good:
                if x in good and y not in group and near(good[x], good[y]):
                    group.add(y)
                    todo.append(y)
        links = sum(k in good and y != k and near(good[k], v) for y, v in good.items())
        low = min(rows[g][0] for g in group)
        out.append((i, links, low, i == low))
    return out


def vectors():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = []
    for k in range(300):
        v = centres[k % 30] + rng.standard_normal(16) * (0.05 if k % 3 else 0.25)
        rows.append((1000 - k, [float(np.float32(x)) for x in v]))
    rows += [(2000, rows[0][1]), (1999, rows[0][1]), (5, None), (6, []), (7, [0.0] * 16), (8, [float("nan")] * 16), (9, [1.0] * 15 + [None]), (10, [1.0, 0.0]), (11, [2.0, 0.01])]
    return rows


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "UNIT_ROWS", 16)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 AS leaf", "1 AS id", "2 AS links")
    got = [tuple(r) for r in embeddings.near_vectors(df, min_cos=0.95, leaf_rows=40, trees=6).collect()]
    assert sorted(got) == sorted(brute_vectors(rows, 0.95))


def test_deep_trees_keep_their_pairs():
    rng = np.random.default_rng(7)
    x = embeddings.unit_rows(rng.standard_normal((4000, 16)))
    other = rng.standard_normal((4000, 16))
    other -= (other * x).sum(axis=1, keepdims=True) * x
    y = 0.955 * x + np.sqrt(1 - 0.955**2) * embeddings.unit_rows(other)
    forest = embeddings.fit_forest({16: x[:2000]}, 4000 << 14, 0.95, None, 512, 0.5, 5)
    assert len(forest.cuts[16]) == embeddings.trees_for(17) and len(forest.cuts[16][0]) == 17 and max(len(c) for c in forest.cuts[16][0]) <= 64
    sides = [{} for _ in range(2)]
    for held, v in zip(sides, (x, y), strict=True):
        for row, leaf in zip(*embeddings.route(forest, v), strict=True):
            held.setdefault(int(row), set()).add(int(leaf))
    assert np.mean([bool(sides[0][k] & sides[1][k]) for k in range(4000)]) > 0.97
    rows, leaves = embeddings.route(forest, np.ones((3, 7)))
    assert rows.tolist() == [0, 1, 2] and len(set(leaves.tolist())) == 1


def test_group_edges_span_components():
    near = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        near[a, b] = near[b, a] = True
    rows, roots = shared.group_edges(near)
    assert dict(zip(rows.tolist(), roots.tolist(), strict=True)) == {3: 0, 5: 0, 2: 1}
