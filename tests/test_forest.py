"""Spanning forests, removal curves and cut nodes against brute force on random graphs."""

import numpy as np
import pytest

from threadloom.operators import cuts, forest, removal


def groups(ids, pairs):
    """Components as sorted lists."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    out = {}
    for i in ids:
        out.setdefault(find(i), []).append(i)
    return sorted(map(sorted, out.values()))


def shapes():
    rng = np.random.default_rng(11)
    path = [(k, k + 1) for k in range(40)]
    star = [(0, k) for k in range(1, 30)]
    ring = [(k, (k + 1) % 25) for k in range(25)]
    barbell = [(a, b) for a in range(6) for b in range(a)] + [(10 + a, 10 + b) for a in range(6) for b in range(a)] + [(0, 10), (3, 20), (20, 21)]
    random = [(int(a), int(b)) for a, b in rng.integers(0, 60, (75, 2)) if a != b]
    dense = [(int(a), int(b)) for a, b in rng.integers(0, 25, (150, 2)) if a != b]
    trees = [(k, int(rng.integers(0, k))) for k in range(1, 50)] + [(60, 61), (61, 62), (62, 60), (62, 63)]
    return {"path": path, "star": star, "ring": ring, "barbell": barbell, "random": random, "dense": dense, "trees": trees, "empty": []}


@pytest.mark.parametrize("limit", [0, 1000])
def test_forest_and_sizes(spark, limit):
    rows, want = [], []
    for g, (name, pairs) in enumerate(shapes().items()):
        rng = np.random.default_rng(g)
        ranked = [(a, b, int(rng.integers(0, 12))) for a, b in pairs]
        rows += [(name, a, b, r) for a, b, r in ranked] + [(name, 3, 3, 0)] + ([(name, ranked[0][1], ranked[0][0], 50)] if ranked else [])
        ids, taken = sorted({x for p in pairs for x in p}), []
        for r, a, b in sorted((r, a, b) for a, b, r in ranked):
            before = groups(ids, taken)
            if not any(a in x and b in x for x in before):
                taken.append((a, b))
                want.append((name, a, b, r, next(len(x) for x in groups(ids, taken) if a in x)))
    edges = spark.createDataFrame(rows, "graph string, a long, b long, rank long")
    found = forest.spanning_forest(edges, limit)
    assert sorted(tuple(r) for r in found.collect()) == sorted(w[:4] for w in want)
    sizes = forest.merge_sizes(found, limit or 4)
    assert sorted((r.graph, r.a, r.b, r["rank"], r["size"]) for r in sizes.collect()) == sorted(want)


def test_curves_of_whole_orders(spark, monkeypatch):
    monkeypatch.setattr(forest, "LIMIT", 20)
    pairs = shapes()["random"]
    ids = list(range(62))
    orders = [np.random.default_rng(t).permutation(ids).tolist() for t in range(3)]
    order = spark.createDataFrame([(t, i, k) for t, o in enumerate(orders) for k, i in enumerate(o, 1)], "trial int, id long, place int")
    ties = spark.createDataFrame(pairs + [(900, 1)], "a long, b long")
    got = {(r.trial, r.removed): (r.giant, r.left) for r in removal.removal_curve(order, ties).collect()}
    for t, o in enumerate(orders):
        for k in range(len(ids) + 1):
            kept = set(o[k:])
            best = max((len(x) for x in groups(kept, [p for p in pairs if kept.issuperset(p)])), default=0)
            assert got[t, k] == (best, len(kept))
    assert len(got) == 3 * 63
    few = removal.removal_curve(order, ties, [0, 5, 61, 62, 90]).where("trial = 1").collect()
    assert sorted((r.removed, r.giant) for r in few) == [(k, got[1, k][0]) for k in (0, 5, 61)]
    assert removal.removal_curve(order.limit(0), ties).count() == 0


def without(ids, pairs):
    whole = groups(ids, pairs)
    giant = max(whole, key=lambda x: (len(x), -x[0]), default=[])
    for i in ids:
        rest = groups([x for x in ids if x != i], [p for p in pairs if i not in p])
        held = sorted((len(set(x) & set(giant)) for x in rest), reverse=True)
        yield i, max(map(len, rest), default=0), len(rest), len(rest) - len(whole), sum(held[1:])


def test_deletion_of_every_node(spark):
    for names in (["path", "star", "ring", "barbell", "random", "dense", "trees"], ["barbell"], ["empty"]):
        pairs = [(100 * k + a, 100 * k + b) for k, name in enumerate(names) for a, b in shapes()[name]]
        ids = sorted({x for p in pairs for x in p} | {970, 971})
        nodes = spark.createDataFrame([(i,) for i in ids], "id long")
        ties = spark.createDataFrame([(min(p), max(p)) for p in pairs] + [(1, 999)], "a long, b long")
        got = cuts.single_removal(nodes, ties).select("id", "giant_after", "components", "extra_components", "detached")
        assert sorted(tuple(r) for r in got.collect()) == list(without(ids, pairs))


def test_deletion_over_rounds_of_the_forest(spark, monkeypatch):
    monkeypatch.setattr(forest, "LIMIT", 5)
    pairs = shapes()["random"] + [(100 + a, 100 + b) for a, b in shapes()["barbell"]]
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in ids], "id string")
    ties = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "a string, b string")
    got = cuts.single_removal(nodes, ties).select("id", "giant_after", "components", "extra_components", "detached")
    assert sorted(tuple(r) for r in got.collect()) == [(f"n{i:03}", *rest) for i, *rest in without(ids, pairs)]


def test_preorder_stretches(spark):
    pairs = shapes()["trees"]
    nodes = spark.createDataFrame([(i,) for i in range(64)], "id long")
    tree = {r.id: r for r in cuts.rooted(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert sorted(r.pre for r in tree.values()) == list(range(1, 65))
    below = {i: {i} for i in tree}
    for i in tree:
        x = tree[i].parent
        while x is not None:
            below[x].add(i)
            x = tree[x].parent
    for i, r in tree.items():
        assert {tree[x].pre for x in below[i]} == set(range(r.pre, r.pre + r.size))
