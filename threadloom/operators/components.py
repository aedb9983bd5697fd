"""Connected components by alternating large-star and small-star rounds.

Every round is two joins and two partial aggregates over the edge table; the round's result is
written to the shared folder, so lineage stays short. Values of keys that hold many rows are broadcast
(there are few such keys), so no task reads all neighbours of a node with very many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from threadloom.operators.degrees import ROWS
from threadloom.session import drop_path, materialize


FEW = 1000


def with_value(rows: DataFrame, key: str, value: Column, name: str, total: int | None = None) -> DataFrame:
    """``rows`` with an aggregate ``value`` over each key's rows as ``name``; rows with a null key go.

    The aggregate combines before its shuffle. Rows are read once for it and once to meet it; callers whose rows are
    dear to compute write them first.
    """
    keyed = rows.where(F.col(key).isNotNull())
    return with_found(keyed, keyed.groupBy(key).agg(value.alias(name), F.count("*").alias("_rows")), key, name, total)


def with_found(rows: DataFrame, found: DataFrame, key: str, name: str, total: int | None = None) -> DataFrame:
    """``rows`` with the column ``name`` of ``found(key, name, _rows)``, null where ``found`` lacks the key; no key is null.

    ``_rows`` tells how many of the rows hold a key. One with more than one in ``FEW`` of ``total`` (by default the sum
    over ``found``) is heavy; there are few of these, so theirs are broadcast, and their rows are dealt evenly. The
    other rows meet their value by a shuffle on the key.
    """
    counted = found.withColumn("_all", F.lit(total)) if total is not None else found.crossJoin(F.broadcast(found.agg(F.sum("_rows").alias("_all"))))
    heavy = counted.where(F.col("_rows") * FEW > F.col("_all")).select(key, F.col(name).alias("_value"), F.lit(True).alias("_heavy"))
    part = F.when(F.col("_heavy"), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(FEW))).otherwise(0)
    marked = rows.join(F.broadcast(heavy), key, "left").withColumn("_part", part)
    met = marked.join(found.select(key, name, F.lit(0).cast("long").alias("_part")), [key, "_part"], "left")
    return met.select(*rows.columns, F.coalesce("_value", name).alias(name))


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Write ``edges(hi, lo)`` and read them back, with their number and two checksums measured on the way."""
    h = F.xxhash64("hi", "lo")
    seen = Observation()
    found, path = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("s"), F.bit_xor(h).alias("x")), "cc")
    return found, path, (seen.get["n"], seen.get["s"], seen.get["x"])


def components_of_edges(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(src, dst)`` -> ``(id, component)`` for every endpoint; component is its smallest reachable id.

    Loops, repeated and reversed edges are allowed; rows with a null end are ignored. An empty edge
    table gives an empty result. Isolated nodes are the caller's to add (see :func:`weak_components`).
    """
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    loops = ends.where("src = dst").select(F.col("src").alias("id"))
    pairs = ends.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    current, path, before = _written(pairs)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        large = with_value(both, "u", F.min("v"), "m", 2 * before[0]).where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        small = with_value(large, "hi", F.min("lo"), "m", before[0])
        moved = small.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        following, new_path, after = _written(moved.distinct())
        drop_path(edges.sparkSession, path)
        current, path, settled, before = following, new_path, after == before, after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = current.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    linked = labelled.union(roots)
    alone = loops.distinct().join(linked, "id", "left_anti").select("id", F.col("id").alias("component"))
    return linked.union(alone)


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(id)``, ``edges(src, dst)`` -> ``(id, component)``, isolates included, edges to unknown ids ignored."""
    known = nodes.select("id").distinct()
    inside = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    linked = components_of_edges(inside.select("src", "dst"))
    return known.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def parts_of_groups(edges: DataFrame, most: int = 64) -> DataFrame:
    """``edges(group, a, b)`` -> ``(group, parts)``: into how many components each group's own edges fall.

    A group of at most ``most`` edges is merged edge by edge inside its row; larger ones take the rounds of :func:`components_of_edges`.
    """
    sized = edges.where("a IS NOT NULL AND b IS NOT NULL").select("group", "a", "b", F.count("*").over(Window.partitionBy("group")).alias("_n"))
    held, _ = materialize(sized, "groups")
    none = F.array().cast(f"array<array<{edges.schema['a'].dataType.simpleString()}>>")

    def merged(acc: Column, x: Column) -> Column:
        touched = lambda s: F.array_contains(s, x["a"]) | F.array_contains(s, x["b"])
        whole = F.array_distinct(F.concat(F.flatten(F.filter(acc, touched)), F.array(x["a"], x["b"])))
        return F.concat(F.filter(acc, lambda s: ~touched(s)), F.array(whole))

    small = held.where(F.col("_n") <= most)
    parts = max(1, math.ceil(small.count() / ROWS))  # so a task's share does not grow with the table
    listed = small.repartition(parts, "group").groupBy("group").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    counts = listed.select("group", F.size(F.aggregate("edges", none, merged)).cast("long").alias("parts"))
    large = held.where(F.col("_n") > most)
    if large.isEmpty():
        return counts
    end = lambda c: F.struct("group", F.col(c).alias("id"))
    found = components_of_edges(large.select(end("a").alias("src"), end("b").alias("dst")))
    return counts.union(found.groupBy("id.group").agg(F.countDistinct("component").alias("parts")))


def _reach_least(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """Fixpoint of ``labels(id, label)`` under passing the smaller label along ``arcs(src, dst)``."""
    spark = labels.sparkSession
    current, path = materialize(labels, "reach")
    while True:
        passed = arcs.join(current.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.col("label").alias("in"))
        least = passed.groupBy("id").agg(F.min("in").alias("in"))
        after = current.join(least, "id", "left").select("id", F.least("label", "in").alias("label"), (F.col("in") < F.col("label")).alias("moved"))
        following, new_path = materialize(after, "reach")
        moved = not following.where("moved").isEmpty()
        drop_path(spark, path)
        current, path = following.select("id", "label"), new_path
        if not moved:
            return current


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` of mutual reachability; component is the smallest member.

    Each round settles nodes without an arc in or out on their own, colours the rest by the smallest id
    that reaches them, and settles those that reach the id of their colour inside it.
    """
    left, _ = materialize(nodes.select("id").distinct(), "scc")
    arcs, _ = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    settled = None
    while not left.isEmpty():
        ends = arcs.select(F.col("src").alias("id")).distinct().join(arcs.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        inner = left.join(ends, "id", "left_semi")
        trimmed = left.join(ends, "id", "left_anti").select("id", F.col("id").alias("component"))
        colour = _reach_least(inner.select("id", F.col("id").alias("label")), arcs)
        inside = arcs.join(colour.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst").where("ls = ld")
        inside, _ = materialize(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc")
        # Against the arcs, only a colour's own id starts with a label; who receives it reaches that id.
        start = colour.select("id", F.when(F.col("id") == F.col("label"), 0).otherwise(1).alias("label"))
        back = _reach_least(start, inside).where("label = 0").select("id")
        found = colour.join(back, "id", "left_semi").select("id", F.col("label").alias("component")).union(trimmed)
        found, _ = materialize(found, "scc")
        settled = found if settled is None else settled.union(found)
        left, _ = materialize(left.join(found, "id", "left_anti"), "scc")
        gone = found.select("id")
        arcs, _ = materialize(arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "scc")
    return settled if settled is not None else left.select("id", F.col("id").alias("component"))


def giant(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Ids of the largest component; the smallest first member wins ties."""
    sizes = membership.groupBy("component").agg(F.count("*").alias("size"))
    top = sizes.orderBy(F.desc("size"), "component").limit(1)
    return membership.join(F.broadcast(top), "component", "left_semi").select("id")
