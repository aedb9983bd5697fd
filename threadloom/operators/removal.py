"""Resilience: the largest component while nodes go, for whole orders of removal at once.

Read backwards, an order adds nodes, and a tie enters with the earlier of its two ends. So a spanning forest of the
ties by that place holds the whole curve: at most one edge a node, whatever the number of states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.forest import merge_sizes, spanning_forest
from threadloom.operators.ranks import placed, running_max


def removal_curve(order: DataFrame, pairs: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """``order(trial, id, place)`` (places from 1, a permutation per trial) -> ``(trial, removed, giant, left)``.

    The state after ``removed`` nodes keeps those of later places; without ``steps`` every count from 0 to n is returned, else
    those that leave a node. Ties with an end outside the order are ignored.
    """
    at = lambda c: order.select("trial", F.col("id").alias(c), F.col("place").alias(f"place_{c}"))
    met = pairs.select("a", "b").join(at("a"), "a").join(at("b"), ["trial", "b"])
    edges = met.select(F.col("trial").alias("graph"), "a", "b", (-F.least("place_a", "place_b")).cast("long").alias("rank"))
    sizes = merge_sizes(spanning_forest(edges)).groupBy(F.col("graph").alias("trial"), (-F.col("rank")).alias("place")).agg(F.max("size").alias("size"))
    states = order.select("trial", F.col("place").cast("long").alias("place")).join(sizes, ["trial", "place"], "left").select("trial", "place", F.coalesce("size", F.lit(1)).alias("size"))
    curve = running_max(states, "trial", "size", "giant", F.desc("place"))
    counts = order.groupBy("trial").agg(F.count("*").alias("n"))
    kept = curve.join(F.broadcast(counts), "trial").select("trial", (F.col("place") - 1).alias("removed"), "giant", (F.col("n") - F.col("place") + 1).alias("left"))
    if steps is not None:
        return kept.where(F.col("removed").isin(steps))
    return kept.union(counts.select("trial", "n", F.lit(0), F.lit(0)))


def hub_removal(order: DataFrame, pairs: DataFrame, steps: list[int]) -> DataFrame:
    """``(removed, giant, share_of_original, share_of_remaining)`` of one fixed order."""
    curve = removal_curve(order.withColumn("trial", F.lit(0)), pairs, steps)
    return curve.select("removed", "giant", (F.col("giant") / (F.col("left") + F.col("removed"))).alias("share_of_original"), (F.col("giant") / F.col("left")).alias("share_of_remaining"))


def trial_band(curve: DataFrame) -> DataFrame:
    """``(removed, mean, p05, p95)`` over trials; the bounds are order statistics, not interpolated percentiles."""
    g = F.sort_array(F.collect_list("giant"))
    n = F.size("g")
    return curve.groupBy("removed").agg(g.alias("g"), F.avg("giant").alias("mean")).select(
        "removed", "mean",
        F.element_at("g", F.floor((n - 1) * 0.05).cast("int") + 1).alias("p05"),
        F.element_at("g", F.ceil((n - 1) * 0.95).cast("int") + 1).alias("p95"),
    )


def hashed_orders(nodes: DataFrame, trials: int) -> DataFrame:
    """Reproducible pseudo-random permutations ``(trial, id, place)`` of distinct ids: by the MD5 of trial and id."""
    numbered = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    key = F.md5(F.concat_ws("-", F.col("trial").cast("string"), F.col("id").cast("string")))
    every = placed(numbered.select("trial", "id", key.alias("key")), "place", F.col("trial"), F.col("key"), F.col("id"))
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))
    return every.crossJoin(n).select("trial", "id", (F.col("place") - F.col("trial") * F.col("n")).alias("place"))
