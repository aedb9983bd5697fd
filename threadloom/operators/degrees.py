"""Degree, reciprocity and friendship measures. Every table starts from the roster, so isolates stay."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialize

#: Rows of a part where the number of parts follows the table, so that a task's memory does not grow with it.
ROWS = 500_000


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs ``(a, b)`` with a < b; loops drop, reciprocal arcs collapse."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """``(id, nbr)`` in both directions from ``(a, b)``."""
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("nbr")).union(pairs.select("b", "a"))


def degree_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, in_degree, out_degree, total_degree, degree)``; loops count in and out, not in ``degree``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    directed = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    near = both_ways(undirected(edges)).groupBy("id").agg(F.count("*").alias("degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = nodes.select("id").join(directed, "id", "left").join(near, "id", "left").select("id", zero("in_degree"), zero("out_degree"), zero("degree"))
    return joined.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"), "degree")


def leaders(table: DataFrame, measure: str, k: int) -> DataFrame:
    """The ``k`` largest by ``measure``, ids ascending among ties, with their 1-based place."""
    top = table.orderBy(F.desc(measure), "id").limit(k)
    return top.select("id", F.col(measure).alias("value"), F.row_number().over(Window.orderBy(F.desc(measure), "id")).alias("place"))


def distribution(table: DataFrame, measure: str) -> DataFrame:
    """``(value, nodes, probability)`` over the whole roster, zero included."""
    total = table.agg(F.count("*").alias("n"))
    counts = table.groupBy(F.col(measure).alias("value")).agg(F.count("*").alias("nodes"))
    return counts.crossJoin(F.broadcast(total)).select("value", "nodes", (F.col("nodes") / F.col("n")).alias("probability"))


def ccdf(table: DataFrame, measure: str) -> DataFrame:
    """``(value, at_least, probability)``: the share of positive nodes whose measure is ``value`` or more."""
    counts = table.where(F.col(measure) > 0).groupBy(F.col(measure).alias("value")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return counts.select("value", F.sum("n").over(down).alias("at_least"), F.sum("n").over(everything).alias("all")).select("value", "at_least", (F.col("at_least") / F.col("all")).alias("probability"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row: loop-free arcs, how many are answered, pairs, and their share (null without arcs)."""
    arcs = edges.where("src <> dst").select("src", "dst").distinct()
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("answered"))
    both = arcs.join(back, ["src", "dst"], "left").agg(F.count("*").alias("arcs"), F.count("answered").alias("reciprocal_arcs"))
    return both.select("arcs", "reciprocal_arcs", F.floor(F.col("reciprocal_arcs") / 2).cast("long").alias("pairs"), (F.col("reciprocal_arcs") / F.nullif(F.col("arcs"), F.lit(0))).alias("reciprocity"))


def unanswered_arcs(edges: DataFrame) -> DataFrame:
    arcs = edges.where("src <> dst").select("src", "dst").distinct()
    return arcs.join(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of sizes, means, medians, zero counts, loops and reciprocity."""
    d = degree_table(nodes, edges)
    shape = d.agg(
        F.count("*").alias("nodes"),
        F.sum("out_degree").alias("arcs"),
        F.sum((F.col("total_degree") == 0).cast("long")).alias("isolates"),
        F.avg("in_degree").alias("mean_in"),
        F.median("in_degree").alias("median_in"),
        F.median("out_degree").alias("median_out"),
        F.sum((F.col("in_degree") == 0).cast("long")).alias("zero_in"),
        F.sum((F.col("out_degree") == 0).cast("long")).alias("zero_out"),
    )
    loops = edges.agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"))
    return shape.crossJoin(loops).crossJoin(reciprocity(edges).select("reciprocal_arcs", F.col("pairs").alias("reciprocal_pairs"), "reciprocity"))


def same_coordinates(table: DataFrame) -> DataFrame:
    """Each node with the number of nodes that share its in- and out-degree."""
    counts = table.groupBy("in_degree", "out_degree").agg(F.count("*").alias("sharing"))
    return table.select("id", "in_degree", "out_degree").join(counts, ["in_degree", "out_degree"]).select("id", "in_degree", "out_degree", "sharing")


def friendship_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: degree, mean and largest neighbour degree, first neighbour of that degree, and the paradox flags.

    ``paradox`` is strict (mean neighbour degree above one's own), ``beats_paradox`` is not its strict
    negation: it holds at equality too, and never for isolates.
    """
    ties, _ = materialize(undirected(edges), "ties")  # read three times
    near = both_ways(ties)
    size = near.groupBy("id").agg(F.count("*").alias("degree"))
    seen = near.join(size.select(F.col("id").alias("nbr"), F.col("degree").alias("k")), "nbr").select("id", "nbr", "k")
    met = seen.repartition(max(1, math.ceil(2 * ties.count() / ROWS)), "id").groupBy("id").agg(F.avg("k").alias("mean_friend"), F.max("k").alias("max_friend"), F.min(F.struct(-F.col("k"), F.col("nbr")))["nbr"].alias("top_friend"))
    d = F.coalesce("degree", F.lit(0))
    out = nodes.select("id").join(size, "id", "left").join(met, "id", "left")
    friend, most = F.coalesce("mean_friend", F.lit(0.0)), F.coalesce("max_friend", F.lit(0))
    return out.select(
        "id", d.alias("degree"), friend.alias("mean_friend"), most.alias("max_friend"), "top_friend",
        ((d > 0) & (friend > d)).alias("paradox"), ((d > 0) & (d >= friend)).alias("beats_paradox"), ((d > 0) & (d >= most)).alias("undefeated"),
    )


def friendship_summary(profile: DataFrame) -> DataFrame:
    """One row: connected nodes, those in the paradox and their share, mean degree, and the mean degree at an edge's end."""
    return profile.agg(
        F.count(F.when(F.col("degree") > 0, 1)).alias("connected"),
        F.count(F.when(F.col("paradox"), 1)).alias("in_paradox"),
        F.avg("degree").alias("mean_degree"),
        (F.sum(F.col("degree") * F.col("degree")) / F.nullif(F.sum("degree"), F.lit(0))).alias("edge_end_mean"),
    ).select("connected", "in_paradox", (F.col("in_paradox") / F.nullif(F.col("connected"), F.lit(0))).alias("share"), "mean_degree", "edge_end_mean")


def versus_counts(profile: DataFrame, least_degree: int = 2, gap: float = 0.8) -> DataFrame:
    """Per node of ``least_degree`` or more: how many other such nodes differ by ``gap`` or more in mean neighbour degree.

    Counted from the cumulative distribution of the measure, without forming pairs.
    """
    pool = profile.where(F.col("degree") >= least_degree).select("id", F.round("mean_friend", 6).alias("m"))
    levels = pool.groupBy("m").agg(F.count("*").alias("n"))
    marks = levels.select("m", "n", F.lit(None).cast("double").alias("at")).union(
        levels.select(F.round(F.col("m") - gap, 6), F.lit(0), F.col("m")).union(levels.select(F.round(F.col("m") + gap, 6), F.lit(0), F.col("m")))
    )
    up = Window.orderBy("m").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("m")).rangeBetween(Window.unboundedPreceding, 0)
    found = marks.select("at", "m", F.sum("n").over(up).alias("below"), F.sum("n").over(down).alias("above")).where("at IS NOT NULL")
    both = found.groupBy("at").agg(F.sum(F.when(F.col("m") < F.col("at"), F.col("below")).otherwise(F.col("above"))).alias("opponents"))
    return pool.join(both.withColumnRenamed("at", "m"), "m").select("id", F.col("m").alias("mean_friend"), "opponents")


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return nodes.select("id").join(ends, "id", "left_anti")
