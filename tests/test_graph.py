"""Hand-computed graph fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from threadloom.operators import components, cuts, degrees, partitions, paths, ranks, removal, weighted


def nodes(spark, ids):
    return spark.createDataFrame([(i, i) for i in ids], "id string, name string")


def arcs(spark, pairs):
    return spark.createDataFrame([(p[0], p[1]) for p in pairs], "src string, dst string")


def ties(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight double")


def partition(spark, **labels):
    return spark.createDataFrame(list(labels.items()), "id string, label long")


def test_small_graph(spark):
    n, e = nodes(spark, "ABCDE"), arcs(spark, ["AB", "BA", "BC"])
    table = {r.id: r for r in degrees.degree_table(n, e).collect()}
    assert (table["B"].in_degree, table["B"].out_degree, table["B"].degree, table["B"].total_degree) == (1, 2, 2, 3)
    assert sorted(r.id for r in degrees.isolates(n, e).collect()) == ["D", "E"]
    r = degrees.reciprocity(e).first()
    assert (r.arcs, r.reciprocal_arcs, r.pairs) == (3, 2, 1) and abs(r.reciprocity - 2 / 3) < 1e-12
    assert {(r.value, r.nodes, round(r.probability, 6)) for r in degrees.distribution(degrees.degree_table(n, e), "in_degree").collect()} == {(0, 2, 0.4), (1, 3, 0.6)}
    weak = components.weak_components(n, e).groupBy("component").count().collect()
    assert sorted(r["count"] for r in weak) == [1, 1, 3]
    strong = components.strong_components(n, e).groupBy("component").count().collect()
    assert sorted(r["count"] for r in strong) == [1, 1, 1, 2]


def test_no_arcs(spark):
    n, e = nodes(spark, "ABCDE"), arcs(spark, [])
    s = degrees.graph_summary(n, e).first()
    assert (s.nodes, s.arcs, s.isolates, s.loops, s.reciprocity) == (5, 0, 5, 0, None)
    assert components.weak_components(n, e).select("component").distinct().count() == 5


def test_longer_components(spark):
    chain = [(f"n{k:03}", f"n{k + 1:03}") for k in range(60)]
    ring = [(f"m{k}", f"m{(k + 1) % 9}") for k in range(9)]
    got = {r.id: r.component for r in components.components_of_edges(arcs(spark, [*chain, *ring, ("z", "z")])).collect()}
    assert {got[f"n{k:03}"] for k in range(61)} == {"n000"} and {got[f"m{k}"] for k in range(9)} == {"m0"} and got["z"] == "z"
    strong = {r.id: r.component for r in components.strong_components(nodes(spark, got), arcs(spark, [*chain[:5], *ring])).collect()}
    assert {strong[f"m{k}"] for k in range(9)} == {"m0"} and strong["n003"] == "n003"


def test_removal_after_one(spark):
    n = nodes(spark, "ABCDE")
    order = spark.createDataFrame([(c, k) for k, c in enumerate("BACDE", 1)], "id string, place int")
    row = {r.removed: r for r in removal.hub_removal(order, degrees.undirected(arcs(spark, ["AB", "BC"])), [0, 1, 9]).collect()}
    assert (row[1].giant, row[1].share_of_original, row[1].share_of_remaining) == (1, 0.2, 0.25) and 9 not in row
    assert n.count() == 5


def all_pairs(spark, n, e):
    return paths.distances(n.select(F.col("id").alias("src")), degrees.both_ways(degrees.undirected(e)))


@pytest.mark.parametrize(
    "ids, pairs, want",
    [
        ("ABCD", ["AB", "BC", "CD"], {"A": 0, "B": 2 / 3, "C": 2 / 3, "D": 0}),
        ("ABCE", ["AB", "BC"], {"A": 0, "B": 1 / 3, "C": 0, "E": 0}),
        ("ABCD", ["AB", "BC", "CD", "DA"], dict.fromkeys("ABCD", 1 / 6)),
        ("ABC", ["AB", "BA", "AA", "BC"], {"A": 0, "B": 1, "C": 0}),
        ("AB", ["AB"], {"A": 0, "B": 0}),
    ],
)
def test_betweenness(spark, ids, pairs, want):
    n, e = nodes(spark, ids), arcs(spark, pairs)
    got = {r.id: r.betweenness for r in paths.betweenness(n, degrees.both_ways(degrees.undirected(e))).collect()}
    assert got == pytest.approx(want)


def test_routes_take_the_smallest_path(spark):
    e = arcs(spark, ["AC", "CD", "AB", "BD"])
    found = {r.node: (r.dist, r.route) for r in paths.routes("A", degrees.both_ways(degrees.undirected(e))).collect()}
    assert found["D"] == (2, ["A", "B", "D"]) and found["A"] == (0, ["A"]) and "Island" not in found
    directed = {r.node for r in paths.routes("C", e.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))).collect()}
    assert directed == {"C", "D"}


def test_distance_census(spark):
    n, e = nodes(spark, "ABC"), arcs(spark, ["AB"])
    got = {r.bucket: (r.pairs, round(r.share, 6)) for r in paths.distance_census(n, all_pairs(spark, n, e)).collect()}
    assert got == {"1": (1, 0.333333), "2": (0, 0.0), "3": (0, 0.0), "4+": (0, 0.0), "disconnected": (2, 0.666667)}


def test_every_removal_order(spark):
    pairs = ["AB", "BC", "BD", "DC"]
    orders = list(itertools.permutations("ABCDE"))
    order = spark.createDataFrame([(t, c, k) for t, o in enumerate(orders) for k, c in enumerate(o, 1)], "trial int, id string, place int")
    got = {(r.trial, r.removed): r.giant for r in removal.removal_curve(order, degrees.undirected(arcs(spark, pairs))).collect()}
    for t, o in enumerate(orders):
        for k in range(6):
            kept, best = set(o[k:]), 0
            for start in kept:
                seen, todo = {start}, [start]
                while todo:
                    x = todo.pop()
                    for p in pairs:
                        if x in p and (y := p.replace(x, "")) in kept and y not in seen:
                            seen.add(y)
                            todo.append(y)
                best = max(best, len(seen))
            assert got[t, k] == best
    band = {r.removed: r for r in removal.trial_band(removal.removal_curve(order, degrees.undirected(arcs(spark, pairs)))).collect()}
    assert band[0].mean == 4 and band[5].mean == 0 and band[0].p05 == band[0].p95 == 4


def test_single_removal(spark):
    n, e = nodes(spark, "ABCDE"), arcs(spark, ["AB", "BC", "BD"])
    got = {r.id: r for r in cuts.single_removal(n, degrees.undirected(e)).collect()}
    assert (got["B"].giant_after, got["B"].detached, got["B"].extra_components) == (1, 2, 2)
    assert got["E"].detached == 0 and got["A"].giant_after == 3


def test_friendship_flags(spark):
    got = {r.id: r for r in degrees.friendship_profile(nodes(spark, "ABCDE"), arcs(spark, ["AB", "AC", "AD"])).collect()}
    assert got["B"].paradox and not got["A"].paradox and got["A"].beats_paradox and got["A"].undefeated
    assert got["B"].top_friend == "A" and not got["E"].beats_paradox and got["E"].top_friend is None


def test_modularity_and_aggregation(spark):
    t = ties(spark, [("A", "B", 2.0), ("B", "C", 1.0)])
    p = partition(spark, A=0, B=0, C=1)
    q = partitions.modularity(t, p).first()[0]
    above = partitions.super_graph(t, p)
    assert {(r.a, r.b, r.weight) for r in above.collect()} == {(0, 0, 2.0), (0, 1, 1.0)}
    same = spark.createDataFrame([(0, 0), (1, 1)], "id long, label long")
    assert partitions.modularity(above, same).first()[0] == pytest.approx(q)
    assert partitions.modularity(t, partition(spark, A=0, B=0, C=0)).first()[0] == pytest.approx(0)
    assert partitions.modularity(ties(spark, []), p).first()[0] == 0


def test_partition_comparison(spark):
    a = partition(spark, A=0, B=0, C=1, D=1)
    nmi = lambda b: partitions.mutual_information(partitions.contingency(a, b)).first()[0]
    assert nmi(partition(spark, A=7, B=7, C=3, D=3)) == pytest.approx(1)
    assert nmi(partition(spark, A=0, B=1, C=0, D=1)) == pytest.approx(0)
    one = partition(spark, A=0, B=0, C=0, D=0)
    assert partitions.mutual_information(partitions.contingency(one, one)).first()[0] == 1
    assert partitions.rand_index(partitions.contingency(a, partition(spark, A=0, B=1, C=0, D=1))).first()[0] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        partitions.check_same_nodes(a, partition(spark, A=0, X=1))


def test_alignment_beats_greedy(spark):
    left = {f"x{k}": 0 if k < 11 else 1 for k in range(16)}
    right = {f"x{k}": (0 if k < 6 else 1) if k < 11 else 0 for k in range(16)}
    a, b = partition(spark, **left), partition(spark, **right)
    aligned = {r.id: r.label for r in partitions.align(a, b).collect()}
    assert sum(aligned[k] == v for k, v in left.items()) == 10
    for n in (1, 2, 3, 4, 5):
        import numpy as np

        overlap = np.random.default_rng(n).integers(0, 9, (n, n))
        best = max(sum(overlap[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(n)))
        assert sum(overlap[r, c] for r, c in enumerate(partitions.assignment(overlap))) == best


def test_disparity_and_backbone(spark):
    t = ties(spark, [("A", "B", 2.0), ("A", "C", 7.0), ("B", "D", 1.0)])
    alpha = {(r.a, r.b): r.alpha for r in weighted.disparity(t).collect()}
    assert alpha["A", "B"] == pytest.approx(1 / 3)
    t = ties(spark, [("A", "B", 2.0), ("B", "C", 1.0), ("B", "D", 1.0)])
    got = {r.alpha: (r.nodes, r.ties, r.giant, r.components) for r in weighted.backbone_metrics(nodes(spark, "ABCD"), weighted.disparity(t), [0.2, 0.25, 0.3, 1.0]).collect()}
    assert got[0.2] == (0, 0, 0, 4) and got[0.3] == (2, 1, 2, 3) and got[1.0] == (4, 3, 4, 1) and got[0.25] == (0, 0, 0, 4)
    events = {r.event: r for r in weighted.breakpoints(nodes(spark, "ABCD"), weighted.disparity(t)).collect()}
    assert events["first_fragmentation"].giant_looser == 4 and events["half_giant"].alpha == pytest.approx(0.25)
    assert events["half_giant"].joining_ties == 1 and events["first_fragmentation"].removed_ties == 2 and events["first_fragmentation"].joining_ties == 2
    t = spark.createDataFrame([(1, 2, 0.1), (3, 4, 0.1), (2, 3, 0.2), (1, 3, 0.2), (1, 4, 0.3)], "a long, b long, alpha double")
    n = spark.range(1, 5)
    joins = sorted(tuple(r) for r in weighted.critical_ties(n, t).collect() if r.event == "first_fragmentation")
    assert joins == [("first_fragmentation", 1, 1, 3, 2, 2), ("first_fragmentation", 2, 2, 3, 2, 2)]


def test_louvain_finds_two_groups(spark):
    rows = [("1", "2", 2.0), ("2", "3", 2.0), ("4", "5", 2.0), ("5", "6", 2.0), ("3", "4", 0.1)]
    t = ties(spark, rows).selectExpr("cast(a AS long) a", "cast(b AS long) b", "weight")
    found = partitions.louvain(t)
    label = {r.id: r.label for r in found.collect()}
    assert label == {r.id: r.label for r in partitions.louvain(t).collect()}
    assert partitions.modularity(t, found).first()[0] > 0.3
    assert label[1] == label[2] and label[5] == label[6] and label[1] != label[6]


def best_partition(rows, ids):
    """Largest modularity over all partitions of a few nodes."""
    m = sum(w for *_, w in rows)
    k = {i: sum(w * ((a == i) + (b == i)) for a, b, w in rows) for i in ids}

    def partitions_of(left):
        if not left:
            yield []
            return
        for rest in partitions_of(left[1:]):
            yield [[left[0]], *rest]
            for n in range(len(rest)):
                yield [*rest[:n], [left[0], *rest[n]], *rest[n + 1 :]]

    return max(sum(sum(w for a, b, w in rows if a in c and b in c) / m - (sum(k[i] for i in c) / (2 * m)) ** 2 for c in p) for p in partitions_of(list(ids)))


def test_search_comes_near_the_optimum_of_small_graphs(spark):
    import numpy as np

    rng, graphs = np.random.default_rng(3), {}
    for g in range(6):
        pairs = [(a, b) for a in range(9) for b in range(a) if rng.random() < (0.8 if a // 3 == b // 3 else 0.2)]
        graphs[g] = [(b, a, float(rng.integers(1, 4))) for a, b in pairs]
    seen = {}
    table = spark.createDataFrame([(g, *r) for g, rows in graphs.items() for r in rows], "run int, a long, b long, weight double")
    found = partitions.louvain_runs(table, dict.fromkeys(graphs, 5))
    for r in found.collect():
        seen.setdefault(r.run, {})[r.id] = r.label
    for g, rows in graphs.items():
        m, label = sum(w for *_, w in rows), seen[g]
        held = {}
        for a, b, w in rows:
            held[label[a]] = held.get(label[a], 0) + w
            held[label[b]] = held.get(label[b], 0) + w
        q = sum(w for a, b, w in rows if label[a] == label[b]) / m - sum((x / (2 * m)) ** 2 for x in held.values())
        assert best_partition(rows, sorted(label)) - 0.02 <= q
    alone = partitions.louvain_runs(table.where("run = 2"), {2: 5})
    assert {(r.id, r.label) for r in alone.collect()} == set(seen[2].items())


def test_every_round_raises_modularity(spark, monkeypatch):
    import numpy as np

    rng, steps, known = np.random.default_rng(8), [], partitions._proposals
    rows = [(int(a), int(b), 1.0) for a, b in {tuple(sorted(p)) for p in rng.integers(0, 40, (160, 2)).tolist() if p[0] != p[1]}]

    def watched(pairs, degrees, partition, turns, resolution):
        steps.append(partitions._qualities(pairs, degrees, partition, resolution)[0])
        return known(pairs, degrees, partition, turns, resolution)

    monkeypatch.setattr(partitions, "_proposals", watched)
    t = spark.createDataFrame(rows, "a long, b long, weight double")
    found = partitions.louvain(t, seed=1)
    assert partitions.modularity(t, found).first()[0] == pytest.approx(steps[-1])
    rises = np.diff(steps)
    assert (rises > -1e-12).all() and (rises > 1e-12).sum() >= len(rises) - 6  # no move where a level starts or ends


def test_runs_of_the_search(spark):
    rows = [(1, 2, 2.0), (2, 3, 2.0), (1, 3, 2.0), (4, 5, 2.0), (5, 6, 2.0), (4, 6, 2.0), (3, 4, 0.1)]
    t = spark.createDataFrame(rows, "a long, b long, weight double")
    got = sorted(partitions.stability(t, runs=3).collect())
    best = partitions.modularity(t, partitions.louvain(t)).first()[0]
    assert [r.run for r in got] == [0, 1, 2] and got[0].rand == 1.0
    assert all(r.communities == 2 and r.largest == 3 and r.rand == 1.0 and abs(r.modularity - best) < 1e-9 for r in got)


def test_neighbors_in_order(spark):
    t = ties(spark, [("A", "B", 1.0), ("A", "C", 3.0), ("A", "D", 3.0), ("B", "C", 1.0)])
    got = {(r.id, r.label): (r.neighbors, r.weight, r.members) for r in partitions.neighbor_communities(t, partition(spark, A=0, B=1, C=1, D=1)).collect()}
    assert got["A", 1] == (3, 7.0, ["C", "D", "B"])


def test_places_over_many_partitions(spark):
    rows = [((k * 7919) % 1000, k) for k in range(1000)]
    t = spark.createDataFrame(rows, "x long, id long").repartition(7)
    got = {r.id: r.place for r in ranks.placed(t, "place", F.desc("x"), F.col("id")).collect()}
    want = {i: k for k, (_, i) in enumerate(sorted((-x, i) for x, i in rows), 1)}
    assert got == want
    assert ranks.placed(t.limit(0), "place", "id").collect() == []


def test_values_of_heavy_keys(spark, monkeypatch):
    rows = [(k % 3 if k % 2 else k, k) for k in range(300)] + [(None, 5)]
    t = spark.createDataFrame(rows, "u long, v long")
    want = sorted((u, v, min(y for x, y in rows if x == u)) for u, v in rows if u is not None)
    for few in (3, 1000):
        monkeypatch.setattr(components, "FEW", few)
        assert sorted(tuple(r) for r in components.with_value(t, "u", F.min("v"), "m").select("u", "v", "m").collect()) == want
    star = arcs(spark, [("z", f"n{k:03}") for k in range(400)] + [("n399", "a")])
    monkeypatch.setattr(components, "FEW", 3)
    assert {r.component for r in components.components_of_edges(star).collect()} == {"a"}


def test_null_model_keeps_degrees(spark):
    rows = [(a, b) for a, b in itertools.combinations(range(30), 2) if (a * 7 + b * 3) % 5 == 0]
    pairs = spark.createDataFrame(rows, "a long, b long")
    null = [(r.a, r.b) for r in partitions.degree_preserving_null(pairs, seed=3, rounds=5, buckets=4).collect()]
    count = lambda es: sorted(x for e in es for x in e)
    assert count(null) == count(rows) and len(set(null)) == len(rows) and all(a < b for a, b in null)
    assert len(set(null) - set(rows)) > len(rows) / 4
    parts = lambda es: components.components_of_edges(spark.createDataFrame(es, "src long, dst long")).select("component").distinct().count()
    assert parts(null) <= parts(rows)


def test_versus_counts(spark):
    rows = [(k, 2 + k % 3, v) for k, v in enumerate([1.0, 1.8, 1.79, 2.6, 0.2, 1.0])] + [(9, 1, 50.0)]
    profile = spark.createDataFrame(rows, "id long, degree int, mean_friend double")
    got = {r.id: r.opponents for r in degrees.versus_counts(profile).collect()}
    pool = {i: m for i, d, m in rows if d >= 2}
    assert got == {i: sum(abs(m - o) >= 0.8 - 1e-9 for o in pool.values()) for i, m in pool.items()}
