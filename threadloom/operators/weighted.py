"""Weighted projections, strengths, thresholds and the disparity backbone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.components import weak_components
from threadloom.operators.degrees import both_ways
from threadloom.operators.forest import merge_sizes, spanning_forest
from threadloom.session import materialize


def projection(edges: DataFrame) -> DataFrame:
    """``edges(src, dst, weight)`` -> ``(a, b, weight)`` with a < b: loops drop, weights of both directions add up."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def strengths(pairs: DataFrame) -> DataFrame:
    """``(id, strength, degree)`` of every node with a tie."""
    ends = pairs.select(F.col("a").alias("id"), "weight").union(pairs.select("b", "weight"))
    return ends.groupBy("id").agg(F.sum("weight").alias("strength"), F.count("*").alias("degree"))


def weight_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("weight").cast("int").alias("weight")).agg(F.count("*").alias("ties"))


def weight_threshold(pairs: DataFrame, least: float) -> DataFrame:
    """One row: ties of at least this weight and the nodes they touch."""
    kept = pairs.where(F.col("weight") >= least)
    return kept.agg(F.count("*").alias("ties")).crossJoin(both_ways(kept).agg(F.countDistinct("id").alias("nodes")))


def disparity(pairs: DataFrame) -> DataFrame:
    """Adds ``alpha``: the smaller of the two ends' tail probabilities ``(1 - w/s)**(k - 1)``, which is 1 at degree 1."""
    pairs, _ = materialize(pairs, "ties")  # for the strengths, and to meet them
    s = strengths(pairs)
    end = lambda c: s.select(F.col("id").alias(c), F.col("strength").alias(f"s_{c}"), F.col("degree").alias(f"k_{c}"))
    tail = lambda c: F.when(F.col(f"k_{c}") == 1, 1.0).otherwise(F.pow(1 - F.col("weight") / F.col(f"s_{c}"), F.col(f"k_{c}") - 1))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "weight", F.least(tail("a"), tail("b")).alias("alpha"))


def backbone_metrics(nodes: DataFrame, tails: DataFrame, alphas: list[float]) -> DataFrame:
    """Per alpha: ties with a smaller tail (all of them from alpha 1 on), nodes they touch, giant, components, shares.

    ``giant`` is 0 without ties; ``components`` counts isolates. One spanning forest by tail holds all levels: each of its
    edges joins two components from its tail on.
    """
    spark = nodes.sparkSession
    levels = sorted({float(a) for a in alphas})
    given = F.array(*(F.lit(x) for x in levels))
    enters = lambda alpha: F.array_min(F.filter(given, lambda x: (x >= 1) | (alpha < x)))
    ends = tails.select(F.col("a").alias("id"), "alpha").union(tails.select("b", "alpha")).groupBy("id").agg(F.min("alpha").alias("alpha"))
    grown = merge_sizes(spanning_forest(tails.select(F.lit(0).alias("graph"), "a", "b", F.col("alpha").cast("double").alias("rank"))))
    zero = F.lit(0).cast("long")
    rows = tails.select(enters(F.col("alpha")).alias("at"), F.lit(1).alias("tie"), zero.alias("node"), zero.alias("join"), zero.alias("size"))
    rows = rows.union(ends.select(enters(F.col("alpha")), zero, F.lit(1), zero, zero)).union(grown.select(enters(F.col("rank")), zero, zero, F.lit(1), "size"))
    counts = rows.where("at IS NOT NULL").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("tie", "node", "join")), F.max("size").alias("size"))  # a row per level at most
    asked = spark.createDataFrame([(float(a),) for a in alphas], "level double")
    upto = F.broadcast(asked).join(F.broadcast(counts), F.col("at") <= F.col("level"), "left").groupBy("level")
    held = upto.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tie", "node", "join")), F.coalesce(F.max("size"), F.lit(0)).alias("giant"))
    total = nodes.agg(F.count("*").alias("n")).crossJoin(tails.agg(F.count("*").alias("m")))
    return held.crossJoin(F.broadcast(total)).select(
        F.col("level").alias("alpha"), F.col("tie").alias("ties"), F.col("node").alias("nodes"), "giant", (F.col("n") - F.col("join")).alias("components"),
        (F.col("tie") / F.nullif(F.col("m"), F.lit(0))).alias("tie_share"), (F.col("node") / F.col("n")).alias("node_share"), (F.col("giant") / F.col("n")).alias("giant_share"),
    )


def breakpoints(nodes: DataFrame, tails: DataFrame) -> DataFrame:
    """Where tightening alpha first splits the graph and where the giant falls below half of the nodes.

    One row per event ``(event, alpha, giant_looser, giant_stricter, removed_ties, joining_ties)``; joining ties are
    the removed ones whose ends the stricter graph holds apart. One spanning forest by tail holds all levels: the giant of
    a level is the largest size that an edge up to it leaves.
    """
    spark = nodes.sparkSession
    forest, events = _events(nodes, tails)
    rows = []
    for event, alpha, looser, stricter in events:
        removed = tails.where(F.col("alpha") == alpha).count()
        rows.append((event, alpha, looser, stricter, removed, joining_ties(nodes, tails, alpha, forest).count()))
    return spark.createDataFrame(rows, "event string, alpha double, giant_looser long, giant_stricter long, removed_ties long, joining_ties long")


def _events(nodes: DataFrame, tails: DataFrame) -> tuple[DataFrame, list[tuple[str, float, int, int]]]:
    """The forest's edges ``(a, b, alpha)``, and per event its alpha and the giants with and without the ties of that alpha."""
    n = nodes.count()
    grown = merge_sizes(spanning_forest(tails.select(F.lit(0).alias("graph"), "a", "b", F.col("alpha").cast("double").alias("rank"))))
    needs = {"first_fragmentation": n, "half_giant": n / 2}
    at = grown.agg(*(F.min(F.when(F.col("size") >= need, F.col("rank"))).alias(event) for event, need in needs.items())).first()
    found = []
    for event, need in needs.items():
        if need > 1 and at[event] is not None:
            most = lambda upto: F.coalesce(F.max(F.when(upto, F.col("size"))), F.lit(1))
            found.append((event, at[event], *grown.agg(most(F.col("rank") <= at[event]), most(F.col("rank") < at[event])).first()))
    return grown.select("a", "b", F.col("rank").alias("alpha")), found


def joining_ties(nodes: DataFrame, tails: DataFrame, alpha: float, forest: DataFrame | None = None) -> DataFrame:
    """``(a, b, size_a, size_b)``: ties of tail ``alpha`` between components of the graph of smaller tails, with their sizes.

    A spanning ``forest(a, b, alpha)`` by tail has the same components as the ties, with fewer edges.
    """
    stricter = (tails if forest is None else forest).where(F.col("alpha") < alpha).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    member, _ = materialize(weak_components(nodes, stricter), "joining")
    sized = member.join(member.groupBy("component").agg(F.count("*").alias("size")), "component")
    end = lambda c: sized.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"), F.col("size").alias(f"size_{c}"))
    return tails.where(F.col("alpha") == alpha).join(end("a"), "a").join(end("b"), "b").where("c_a <> c_b").select("a", "b", "size_a", "size_b")


def critical_ties(nodes: DataFrame, tails: DataFrame, most: int = 20) -> DataFrame:
    """``(event, place, a, b, size_a, size_b)``: the first ``most`` joining ties of each event, by the smaller side's size descending, then ids."""
    out = nodes.sparkSession.createDataFrame([], "event string, place int, a long, b long, size_a long, size_b long")
    forest, events = _events(nodes, tails)
    for event, alpha, *_ in events:
        top = joining_ties(nodes, tails, alpha, forest).orderBy(F.desc(F.least("size_a", "size_b")), "a", "b").limit(most)
        place = F.row_number().over(Window.orderBy(F.desc(F.least("size_a", "size_b")), "a", "b"))
        out = out.union(top.select(F.lit(event).alias("event"), place.alias("place"), "a", "b", "size_a", "size_b"))
    return out
