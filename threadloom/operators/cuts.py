"""Cut nodes: what a graph falls into without one node, for every node at once.

A spanning forest is walked as a tour over its arcs, whose order comes from pointer doubling, so the number of rounds
is the logarithm of the tree's size whatever its shape. The tour gives parents, subtree sizes and preorder numbers;
least and largest numbers that a subtree's ties reach are looked up in tables of doubled spans. Two tree edges lie in
one block if a tie closes a cycle through both, which the numbers tell for neighbouring edges; blocks are the
components of those relations. Without a node, the subtrees below it hang together exactly by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import components_of_edges, with_found
from threadloom.operators.degrees import both_ways
from threadloom.operators.forest import spanning_forest
from threadloom.operators.ranks import placed
from threadloom.session import materialize


def _tour(arcs: DataFrame) -> DataFrame:
    """``arcs(id, nbr)`` of a forest, both directions -> ``(arc, id, nbr, back, left)``: arcs numbered, their reverses, and the arcs after each in its tree's tour.

    The arc after (x, y) is the one after (y, x) in the sorted circle around y. A tree's tour starts at the first arc
    of its smallest number and ends before it.
    """
    numbered, _ = materialize(placed(arcs, "arc", "id", "nbr"), "tour")
    first = numbered.groupBy("id").agg(F.min("arc").alias("first"), F.max("arc").alias("last"))
    wrap = first.select(F.col("last").alias("arc"), F.col("first").alias("around"))
    around = numbered.join(wrap, "arc", "left").select(F.col("id").alias("nbr"), F.col("nbr").alias("id"), F.col("arc").alias("back"), F.coalesce("around", F.col("arc") + 1).alias("next"))
    steps, _ = materialize(numbered.join(around, ["id", "nbr"]).select("arc", "id", "nbr", "back", "next"), "tour-steps")
    return steps


def _ranked(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """``steps(arc, next)`` of closed tours, ``starts(next)`` the first arc of each -> ``(arc, left)``: how many arcs follow."""
    ends = starts.withColumn("end", F.lit(True))
    open_ = steps.join(ends, "next", "left").select("arc", F.when(F.col("end"), F.lit(None)).otherwise(F.col("next")).alias("to"), F.when(F.col("end"), 0).otherwise(1).cast("long").alias("left"))
    current, _ = materialize(open_, "tour-rank")
    while not current.where("to IS NOT NULL").isEmpty():
        for _ in range(2):  # two doublings a write
            ahead = current.select(F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
            current = current.join(ahead, "to", "left").select("arc", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"))
        current, _ = materialize(current, "tour-rank")
    return current.select("arc", "left")


def rooted(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes(id)``, ``pairs(a, b)`` -> ``(id, parent, pre, size, root)`` of a spanning forest.

    ``pre`` numbers the nodes from 1 so that a subtree is a stretch of ``size`` numbers; roots are the smallest ids of
    their components and have no parent. Ties with unknown ends are ignored.
    """
    known = nodes.select("id").distinct()
    inside = pairs.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    forest, _ = materialize(spanning_forest(inside.select(F.lit(0).alias("graph"), "a", "b", F.lit(0).alias("rank"))), "rooted")
    member, _ = materialize(components_of_edges(forest.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "rooted-member")
    steps = _tour(both_ways(forest.select("a", "b")))
    heads = member.where("id = component").select("id")
    starts = steps.join(heads, "id").groupBy("id").agg(F.min("arc").alias("next")).select("next")
    left, _ = materialize(_ranked(steps, starts), "rooted-left")
    spans = steps.join(left, "arc").join(left.select(F.col("arc").alias("back"), F.col("left").alias("left_back")), "back").where(F.col("left") > F.col("left_back"))
    below = spans.select(F.col("nbr").alias("id"), F.col("id").alias("parent"), F.col("left").alias("left"), ((F.col("left") - F.col("left_back") + 1) / 2).cast("long").alias("size"))
    sizes = member.groupBy("component").agg(F.count("*").alias("whole"))
    named = known.join(member, "id", "left").select("id", F.coalesce("component", "id").alias("root")).join(below, "id", "left")
    found, _ = materialize(named.join(sizes.select(F.col("component").alias("id"), "whole"), "id", "left"), "rooted-named")
    order = placed(found, "pre", F.col("root"), F.desc_nulls_first("left"))
    return order.select("id", "parent", "pre", F.coalesce("size", "whole", F.lit(1)).alias("size"), "root")


def _lookup(rows: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``names(id, <name>)`` of the id in ``key``; ids of many rows by broadcast."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    return with_found(rows, counts.join(names.withColumnRenamed("id", key), key).select(key, name, "_rows"), key, name)


def _reach(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """``(id, low, high)``: least and largest number among a subtree's nodes and the other ends of its ties.

    A stretch of n numbers is covered by two of the largest power of two within n; the table of such stretches doubles round by round.
    """
    near = ends.groupBy("id").agg(F.min("pre_nbr").alias("low"), F.max("pre_nbr").alias("high"))
    own = tree.join(near, "id", "left").select("pre", F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high"))
    table, _ = materialize(own, "reach")
    asked, _ = materialize(tree.select("id", "pre", "size", F.floor(F.log2("size") + 1e-9).cast("int").alias("level")), "reach-asked")
    out, level, most = None, 0, asked.agg(F.max("level")).first()[0]
    while most is not None and level <= most:
        mine = asked.where(F.col("level") == level).select("id", "pre", (F.col("pre") + F.col("size") - (1 << level)).alias("other"))
        second = table.select(F.col("pre").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        found = mine.join(table, "pre").join(second, "other").select("id", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"))
        out = found if out is None else out.union(found)
        shifted = table.select((F.col("pre") - (1 << level)).alias("pre"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        level += 1
        if level <= most:
            table, _ = materialize(table.join(shifted, "pre", "left").select("pre", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")), "reach")
    return out if out is not None else tree.select("id", F.col("pre").alias("low"), F.col("pre").alias("high"))


def pieces(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes(id)``, ``pairs(a, b)`` -> ``(id, root, whole, piece)``: sizes of the parts that a component of ``whole`` nodes falls into without ``id``.

    One row a part; a node alone in its component has one row whose piece is null.
    """
    tree, _ = materialize(rooted(nodes, pairs), "pieces-tree")
    number = tree.select("id", F.struct("pre", "size").alias("at"))
    known = tree.select("id")
    inside = pairs.where("a <> b").select("a", "b").distinct().join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    first = _lookup(inside, "a", number, "at").withColumnRenamed("at", "at_a")
    ties, _ = materialize(_lookup(first, "b", number, "at").withColumnRenamed("at", "at_b"), "pieces-ties")
    ends = ties.select(F.col("a").alias("id"), F.col("at_b.pre").alias("pre_nbr")).union(ties.select("b", "at_a.pre"))
    reach = _reach(tree, ends)
    apart = (F.col("at_a.pre") + F.col("at_a.size") <= F.col("at_b.pre")) | (F.col("at_b.pre") + F.col("at_b.size") <= F.col("at_a.pre"))
    across = ties.where(apart).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    children = tree.where("parent IS NOT NULL").select("id", "parent", "size").join(reach, "id")
    above = tree.where("parent IS NOT NULL").select("id", F.struct("pre", "size").alias("at"))
    met = _lookup(children, "parent", above, "at").where("at IS NOT NULL")  # the edge above the parent, if it is no root
    closed = met.where((F.col("low") < F.col("at.pre")) | (F.col("high") >= F.col("at.pre") + F.col("at.size"))).select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    blocks, _ = materialize(components_of_edges(across.union(closed)), "pieces-blocks")
    block = tree.join(blocks, "id", "left").select("id", "parent", "root", "size", F.coalesce("component", "id").alias("block"))
    block, _ = materialize(block, "pieces-block")
    below = block.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id"), "block").agg(F.sum("size").alias("piece"))
    own = block.where("parent IS NOT NULL").select("id", "block", F.lit(True).alias("upper"))
    under, _ = materialize(below.join(own, ["id", "block"], "left").where("upper IS NULL").select("id", "piece"), "pieces-under")
    wholes = tree.where("parent IS NULL").select(F.col("id").alias("root"), F.col("size").alias("whole"))
    counted = tree.groupBy("root").agg(F.count("*").alias("_rows")).join(wholes, "root")
    named = with_found(tree.select("id", "parent", "root"), counted.select("root", "whole", "_rows"), "root", "whole")
    cut = named.join(under.groupBy("id").agg(F.sum("piece").alias("cut")), "id", "left")
    upper = cut.where("parent IS NOT NULL").select("id", (F.col("whole") - 1 - F.coalesce("cut", F.lit(0))).alias("piece"))
    return named.drop("parent").join(under.union(upper), "id", "left").select("id", "root", "whole", "piece")


def single_removal(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per node: giant and component count without it, components gained, and members cut off from the original giant.

    The giant is the largest component, the one with the smallest first member among equals.
    """
    parts, _ = materialize(pieces(nodes, pairs), "single")
    per = parts.groupBy("id", "root", "whole").agg(F.count("piece").alias("parts"), F.coalesce(F.max("piece"), F.lit(0)).alias("most"))
    wholes = parts.select("root", "whole").distinct()
    largest = wholes.orderBy(F.desc("whole"), "root").limit(2).agg(F.min_by("root", F.struct(-F.col("whole"), F.col("root"))).alias("giant"), F.max("whole").alias("first"), F.min("whole").alias("second"), F.count("*").alias("top"))
    count = wholes.agg(F.count("*").alias("before"))
    out = per.crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(count))
    inside = F.col("root") == F.col("giant")
    other = F.when(~inside, F.col("first")).when(F.col("top") == 2, F.col("second")).otherwise(0)
    return out.select(
        "id", F.greatest("most", other).alias("giant_after"), (F.col("before") - 1 + F.col("parts")).alias("components"), (F.col("parts") - 1).alias("extra_components"),
        F.when(inside, F.col("whole") - 1 - F.col("most")).otherwise(0).alias("detached"),
    )
