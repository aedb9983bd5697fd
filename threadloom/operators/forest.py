"""Spanning forests by Borůvka rounds, and what hangs together as their edges enter one by one.

Edges dealt into tasks first lose those that close rings among a task's own. Where that doesn't halve them, a round
keeps each component's first edge out, joins the components by pointer jumping, and drops what
became parallel or internal; it halves the components at least. Many graphs settle side by side, told apart by the column
``graph``. A graph of no more than ``LIMIT`` edges ends in one task, so that is the most a task ever holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import components_of_edges, with_found, with_value
from threadloom.operators.ranks import placed
from threadloom.session import materialize

#: Edges that one task takes in whole.
LIMIT = 500_000


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _joins(part: pd.DataFrame, sized: bool) -> pd.DataFrame:
    """Rows of one graph, in the order of their ranks, that join two components; with the joined size if ``sized``."""
    part = part.sort_values(["rank", "a", "b"], kind="stable")
    names, codes = np.unique(np.concatenate([part["u"].to_numpy(), part["v"].to_numpy()]), return_inverse=True)
    u, v = codes[: len(part)].tolist(), codes[len(part) :].tolist()
    up, size, kept, grown = list(range(len(names))), [1] * len(names), [], []
    if sized:
        for end, held in ((u, "su"), (v, "sv")):
            for x, n in zip(end, part[held].tolist(), strict=True):
                size[x] = n
    for k, (x, y) in enumerate(zip(u, v, strict=True)):
        x, y = _root(up, x), _root(up, y)
        if x != y:
            if size[x] < size[y]:
                x, y = y, x
            up[y] = x
            size[x] += size[y]
            kept.append(k)
            grown.append(size[x])
    out = part.iloc[kept]
    return out.assign(size=grown) if sized else out


def _in_tasks(rows: DataFrame, sized: bool) -> DataFrame:
    kinds = dict(rows.dtypes)
    columns = ["graph", "a", "b", "rank"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + (", size long" if sized else "")
    key = ["graph", "segment"] if sized else ["graph"]
    return rows.groupBy(*key).applyInPandas(lambda part: _joins(part, sized)[[*columns, "size"] if sized else columns], schema)


def _thinned(large: DataFrame, limit: int) -> DataFrame:
    """``large(graph, u, v, a, b, rank, n)`` without edges that close a ring of earlier ones among some of their graph's ``n`` edges.

    Edges are dealt into parts of about ``limit``, and each keeps its own forest: what the whole graph's forest holds is in the
    forest of every part that has it. Where a graph has many times more edges than nodes, that leaves few.
    """
    kinds = dict(large.dtypes)
    columns = ["graph", "u", "v", "a", "b", "rank"]
    dealt = large.select(*columns, F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("n") / max(1, limit))).alias("part"))
    return dealt.groupBy("graph", "part").applyInPandas(lambda part: _joins(part, False)[columns], ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def _renamed(rows: DataFrame, names: DataFrame, *values: str) -> DataFrame:
    """``rows(graph, u, v, ...)`` with both ends looked up in ``names(node, <values>)``: structs ``to_u`` and ``to_v``, null where ``node`` is not there."""
    for end in ("u", "v"):
        node = F.struct("graph", F.col(end).alias("id"))
        keyed = rows.withColumn("node", node)
        counts = keyed.groupBy("node").agg(F.count("*").alias("_rows"))
        found = counts.join(names, "node").select("node", F.struct(*values).alias(f"to_{end}"), "_rows")
        rows = with_found(keyed, found, "node", f"to_{end}").drop("node")
    return rows


def _contracted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over ``rows(graph, u, v, a, b, rank)``: the edges chosen, and the rows between the components they join."""
    edge = F.struct("rank", "a", "b").alias("edge")
    ends = rows.select("graph", "u", "v", edge).union(rows.select("graph", "v", "u", edge))
    best = ends.groupBy("graph", "u").agg(F.min(F.struct("edge", "v")).alias("m"))
    best, _ = materialize(best.select("graph", "u", F.col("m.v").alias("v"), F.col("m.edge").alias("edge")), "forest-best")
    chosen = best.groupBy("graph", "edge").agg(F.count("*").alias("by"), F.min("u").alias("head"))
    root = (F.col("by") == 2) & (F.col("u") == F.col("head"))  # the two that chose one edge would point at each other
    up, _ = materialize(best.join(chosen, ["graph", "edge"]).select(F.struct("graph", F.col("u").alias("id")).alias("node"), F.struct("graph", F.when(root, F.col("u")).otherwise(F.col("v")).alias("id")).alias("up")), "forest-up")
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
        found = up.groupBy("up").agg(F.count("*").alias("_rows")).join(above, "up")
        moved, _ = materialize(with_found(up, found.select("up", "above", "_rows"), "up", "above").select("node", F.col("above").alias("up"), (F.col("above") != F.col("up")).alias("moved")), "forest-up")
        up = moved.select("node", "up")
        if moved.where("moved").isEmpty():
            break
    met = _renamed(rows, up.select("node", F.col("up.id").alias("id")), "id").select("graph", F.col("to_u.id").alias("u"), F.col("to_v.id").alias("v"), "a", "b", "rank").where("u <> v")
    picked = chosen.select("graph", "edge.a", "edge.b", "edge.rank")
    return picked, _single(met)


def _single(rows: DataFrame) -> DataFrame:
    """The first of parallel rows."""
    first = rows.groupBy("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("rank", "a", "b")).alias("e"))
    return first.select("graph", "u", "v", "e.a", "e.b", "e.rank")


def spanning_forest(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``edges(graph, a, b, rank)`` -> those ``(graph, a, b, rank)`` that join two components when they enter by rank, then a, then b.

    Loops never do. Repeated and reversed edges are allowed; the first of them counts. Ranks are numbers, ids of any
    ordered type; no column is null.
    """
    limit = LIMIT if limit is None else limit
    rows, _ = materialize(_single(edges.where("a <> b").select("graph", F.col("a").alias("u"), F.col("b").alias("v"), "a", "b", "rank")), "forest")
    done = None
    while True:
        sized, _ = materialize(with_value(rows, "graph", F.count("*"), "n"), "forest")
        found, more = _in_tasks(sized.where(F.col("n") <= limit).drop("n"), sized=False), False
        large = sized.where(F.col("n") > limit)
        before = large.count()
        if before:
            more = True
            thin, _ = materialize(_thinned(large, limit), "forest")
            if 2 * thin.count() <= before:
                rows = thin
            else:
                picked, rows = _contracted(thin)
                rows, _ = materialize(rows, "forest")
                found = found.union(picked)
        found, _ = materialize(found, "forest-edges")
        done = found if done is None else done.union(found)
        if not more:
            return done


def merge_sizes(forest: DataFrame, limit: int | None = None) -> DataFrame:
    """``(graph, a, b, rank, size)``: the nodes that hang together once an edge of the forest and all before it are in.

    A graph of more than ``limit`` edges is halved by rank until its parts are small: the earlier half stands for itself, and
    for the later one its components are single nodes that weigh as much as they hold.
    """
    limit = LIMIT if limit is None else limit
    one = F.lit(1).cast("long")
    rows, _ = materialize(forest.select("graph", F.lit(0).cast("long").alias("segment"), F.col("a").alias("u"), F.col("b").alias("v"), "a", "b", "rank", one.alias("su"), one.alias("sv")), "merge")
    done = None
    while True:
        sized, _ = materialize(with_value(rows.withColumn("g", F.struct("graph", "segment")), "g", F.count("*"), "n"), "merge")
        found, _ = materialize(_in_tasks(sized.where(F.col("n") <= limit).drop("g", "n"), sized=True), "merge-sizes")
        done = found if done is None else done.union(found)
        large = sized.where(F.col("n") > limit)
        if large.isEmpty():
            return done
        order = placed(large, "place", "graph", "segment", "rank", "a", "b")
        halves, _ = materialize(with_value(order, "g", F.min("place"), "first").withColumn("late", (F.col("place") - F.col("first")) * 2 >= F.col("n")), "merge-halves")
        key = F.struct("graph", "segment").alias("graph")
        plain = lambda late: halves.where("late" if late else "NOT late").select(key, "u", "v", "a", "b", "rank", "su", "sv")
        early, end = plain(False), lambda c: F.struct("graph", F.col(c).alias("id"))
        member, _ = materialize(components_of_edges(early.select(end("u").alias("src"), end("v").alias("dst"))), "merge-member")
        weights = early.select(end("u").alias("id"), F.col("su").alias("size")).union(early.select(end("v"), "sv")).distinct()
        held = member.join(weights, "id").groupBy("component").agg(F.sum("size").alias("size"))
        names, _ = materialize(member.join(held, "component").select(F.col("id").alias("node"), F.col("component.id").alias("id"), "size"), "merge-names")
        late = _renamed(plain(True), names, "id", "size")
        at = lambda c, field, own: F.when(F.col(f"to_{c}").isNull(), F.col(own)).otherwise(F.col(f"to_{c}.{field}"))
        late = late.select("graph", at("u", "id", "u").alias("u"), at("v", "id", "v").alias("v"), "a", "b", "rank", at("u", "size", "su").alias("su"), at("v", "size", "sv").alias("sv"))
        both = early.withColumn("half", F.lit(0)).union(late.withColumn("half", F.lit(1)))
        rows, _ = materialize(both.select("graph.graph", (2 * F.col("graph.segment") + F.col("half")).alias("segment"), "u", "v", "a", "b", "rank", "su", "sv"), "merge")
