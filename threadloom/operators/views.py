"""Interactive questions as queries: search, lenses, previews, vector walks, puzzles and release calendars."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.words import label, normalised, short_name
from threadloom.operators.degrees import ROWS, both_ways
from threadloom.session import materialize


def display_names(nodes: DataFrame) -> DataFrame:
    """``(id, label, short, display)``: the short name, or the whole name where another node shares the short one."""
    short = short_name(F.col("name"))
    same = F.count("*").over(Window.partitionBy("short"))
    named = nodes.select("id", "name", label(F.col("name")).alias("label"), short.alias("short"))
    return named.select("id", "label", "short", F.when(same > 1, F.col("name")).otherwise(F.col("short")).alias("display"))


def search(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms(term)``, ``nodes(id, name, in_degree)`` -> the best match: id, then whole name, then label or part of a name by in-degree."""
    t = F.lower(F.trim("term"))
    by_id, by_name = F.lower(F.col("id").cast("string")) == t, F.lower("name") == t
    loose = (t != "") & ((F.lower(label(F.col("name"))) == t) | F.contains(F.lower("name"), t))
    tier = F.when(by_id, 1).when(by_name, 2).when(loose, 3)
    met = nodes.join(F.broadcast(terms), by_id | by_name | loose).select("term", "id", "name", tier.alias("tier"), "in_degree")
    place = F.row_number().over(Window.partitionBy("term").orderBy("tier", F.desc("in_degree"), "id"))
    return met.withColumn("place", place).where("place = 1").select("term", "id", "name", "tier")


def resolve(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per term: the node whose id or name it is (smallest id), else the node whose label it is if there is one only, else null."""
    q = normalised(F.col("term"))
    keyed = nodes.select("id", normalised(F.col("id").cast("string")).alias("i"), normalised(F.col("name")).alias("n"), normalised(label(F.col("name"))).alias("l"))
    met = keyed.join(F.broadcast(terms.select("term", q.alias("q"))), (F.col("i") == F.col("q")) | (F.col("n") == F.col("q")) | (F.col("l") == F.col("q")))
    exact = (F.col("i") == F.col("q")) | (F.col("n") == F.col("q"))
    by = met.groupBy("term").agg(F.min(F.when(exact, F.col("id"))).alias("exact"), F.count(F.when(F.col("l") == F.col("q"), 1)).alias("labels"), F.min(F.when(F.col("l") == F.col("q"), F.col("id"))).alias("by_label"))
    return terms.join(by, "term", "left").select("term", F.coalesce("exact", F.when(F.col("labels") == 1, F.col("by_label"))).alias("id"))


def substring_resolve(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per term: number of names that hold it, and the node if its name or id is the term or only one name holds it."""
    q = normalised(F.replace("term", F.lit("_"), F.lit(" ")))
    plain = lambda c: normalised(F.replace(c, F.lit("_"), F.lit(" ")))
    keyed = nodes.select("id", plain(F.col("id").cast("string")).alias("i"), plain(F.col("name")).alias("n"))
    met = keyed.join(F.broadcast(terms.select("term", q.alias("q")).where("q <> ''")), (F.col("i") == F.col("q")) | F.contains("n", F.col("q")))
    exact = (F.col("i") == F.col("q")) | (F.col("n") == F.col("q"))
    by = met.groupBy("term").agg(F.min(F.when(exact, F.col("id"))).alias("exact"), F.count(F.when(F.contains("n", F.col("q")), 1)).alias("matches"), F.min(F.when(F.contains("n", F.col("q")), F.col("id"))).alias("only"))
    return terms.join(by, "term", "left").select("term", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("exact", F.when(F.col("matches") == 1, F.col("only"))).alias("id"))


def lens(nodes: DataFrame, ties: DataFrame, partition: DataFrame, community: int | None = None, around: int | str | None = None, below_alpha: float | None = None) -> DataFrame:
    """Visible ties ``(a, b, weight)`` of a lens: backbone below an alpha, one community, and one node's neighbourhood."""
    kept = ties if below_alpha is None else ties.where(F.col("alpha") < below_alpha)
    allowed = nodes.select("id") if below_alpha is None else both_ways(kept).select("id").distinct()
    if community is not None:
        allowed = allowed.join(partition.where(F.col("label") == community).select("id"), "id", "left_semi")
    if around is not None:
        near = both_ways(kept).where(F.col("id") == around).select(F.col("nbr").alias("id")).union(nodes.where(F.col("id") == around).select("id"))
        allowed = allowed.join(near.distinct(), "id", "left_semi")
    a, b = allowed.withColumnRenamed("id", "a"), allowed.withColumnRenamed("id", "b")
    return kept.join(a, "a", "left_semi").join(b, "b", "left_semi").select("a", "b", "weight")


def preview(strength: DataFrame, partition: DataFrame, ties: DataFrame, per_group: int = 8, overall: int = 75, below_alpha: float = 0.5, most: int = 500) -> DataFrame:
    """The first ``most`` ties by (alpha, a, b) among the strongest nodes of each community and overall."""
    ranked = strength.join(partition, "id").select("id", "strength", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("strength"), "id")).alias("place"))
    chosen = ranked.where(F.col("place") <= per_group).select("id").union(strength.orderBy(F.desc("strength"), "id").limit(overall).select("id")).distinct()
    inside = ties.where(F.col("alpha") < below_alpha).join(chosen.withColumnRenamed("id", "a"), "a", "left_semi").join(chosen.withColumnRenamed("id", "b"), "b", "left_semi")
    return inside.orderBy("alpha", "a", "b").limit(most).select("a", "b", "alpha")


AXES = ("x", "y", "z")


def tenth(value: Column) -> Column:
    """Rounded to tenths, halves upwards, and kept within 100 of zero."""
    return F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.floor(value * 10 + 0.5) / 10))


def walk(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """``starts(id, x, y, z)``, ``steps(id, place, sign, weight, dx, dy, dz)`` -> end points after the steps in order."""
    ordered = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "sign", "weight", "dx", "dy", "dz"))).alias("steps"))
    joined = starts.join(ordered, "id", "left")
    start = F.struct(*(F.col(c).cast("double").alias(c) for c in AXES))
    move = lambda p, s: F.struct(*(tenth(p[c] + s["sign"] * s["weight"] * s[f"d{c}"]).alias(c) for c in AXES))
    end = F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, move))
    return joined.select("id", end.alias("p")).select("id", "p.x", "p.y", "p.z")


def distance(prefix_a: str, prefix_b: str) -> Column:
    return F.sqrt(sum(F.pow(F.col(prefix_a + c) - F.col(prefix_b + c), 2) for c in AXES))


def nearest_points(points: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` points nearest each probe (``probes(probe, x, y, z)``, a stated set), with a similarity percentage."""
    near = points.select("id", *(F.col(c).alias(f"p{c}") for c in AXES)).join(F.broadcast(probes.select("probe", *(F.col(c).alias(f"q{c}") for c in AXES))))
    d = near.select("probe", "id", F.round(distance("p", "q"), 6).alias("distance"))
    top = d.withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy("distance", "id"))).where(F.col("place") <= k)
    return top.withColumn("percent", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - F.col("distance") + 0.5).cast("int"))))


def proximity(now: Column, first: Column) -> Column:
    """Percentage of the way to a target: 100 on it, 0 from the start's distance and 15 more."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 * (1 - now / (first + 15)) + 0.5).cast("int")))


def greedy_hint(state: DataFrame, palette: DataFrame) -> DataFrame:
    """``state(id, x, y, z, tx, ty, tz)``, ``palette(place, word, dx, dy, dz)`` -> the word whose single step leads nearest the target.

    The palette is a stated set of words, like a game's; every state tries each, inside its row.
    """
    words = palette.agg(F.collect_list(F.struct("place", "word", *(f"d{c}" for c in AXES))).alias("words"))
    d = lambda w: F.sqrt(sum(F.pow(F.col(f"t{c}") - F.col(c) - w[f"d{c}"], 2) for c in AXES))
    tried = F.transform("words", lambda w: F.struct(F.round(d(w), 6).alias("distance"), w["place"].alias("place"), w["word"].alias("word")))
    best = state.crossJoin(F.broadcast(words)).select("id", F.array_min(tried).alias("h")).where("h IS NOT NULL")
    return best.groupBy("id").agg(F.min("h").alias("h")).select("id", "h.word", "h.distance")


def stars(moves: Column, par: Column) -> Column:
    return F.when(moves <= par, 3).when(moves <= par + 2, 2).otherwise(1)


def board_stars(assists: Column) -> Column:
    return F.when(assists == 0, 3).when(assists <= 2, 2).otherwise(1)


def orientation_counts(wires: DataFrame, targets: DataFrame) -> DataFrame:
    """``wires(board, a, b)``, ``targets(board, id, in_target)`` -> ``(board, solutions)`` over all orientations of a board's wires.

    Wire by wire, a partial solution is what its sockets still have to receive, and equal ones are counted together; one
    that gives a socket more than its target ends there. So states are as many as ways to fall short, not as orientations.
    """
    wires, _ = materialize(wires.select("board", "a", "b"), "wires")
    parts = max(1, math.ceil(wires.count() / ROWS))  # so a task's share does not grow with the table
    by_board = lambda df: df.repartition(parts, "board")
    ends = wires.select("board", F.col("a").alias("id"), F.lit(True).alias("wired"), F.lit(None).cast("int").alias("need")).union(wires.select("board", "b", F.lit(True), F.lit(None).cast("int")))
    asked = targets.select("board", "id", F.lit(None).cast("boolean"), F.col("in_target").cast("int"))
    sockets = by_board(ends.union(asked)).groupBy("board", "id").agg(F.max("wired").alias("wired"), F.max("need").alias("need"))
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("need", F.lit(0)).alias("need"))))
    boards, _ = materialize(sockets.groupBy("board").agg(listed.alias("sockets"), F.max("wired").alias("wired")).where("wired").drop("wired"), "boards")
    numbered = by_board(wires).withColumn("turn", F.row_number().over(Window.partitionBy("board").orderBy("a", "b")))
    place = lambda c: F.array_position(F.transform("sockets", lambda s: s["id"]), F.col(c)).cast("int").alias(c)
    steps, _ = materialize(numbered.join(by_board(boards), "board").select("board", "turn", place("a"), place("b")), "wires")
    states = by_board(boards.select("board", F.transform("sockets", lambda s: s["need"]).alias("left"), F.lit(1).cast("long").alias("ways")))
    for turn in range(1, (steps.agg(F.max("turn")).first()[0] or 0) + 1):
        met = states.join(by_board(steps.where(F.col("turn") == turn).select("board", "a", "b")), "board", "left")
        ends = F.when(F.col("a").isNull(), F.array(F.lit(0))).otherwise(F.array("a", "b"))
        given = met.select("board", "left", "ways", F.explode(ends).alias("to")).where("to = 0 OR left[to - 1] > 0")
        after = F.when(F.col("to") == 0, F.col("left")).otherwise(F.transform("left", lambda n, k: n - (k + 1 == F.col("to")).cast("int")))
        states = given.groupBy("board", after.alias("left")).agg(F.sum("ways").alias("ways"))
        if turn % 3 == 0:
            states = by_board(materialize(states, "boards")[0])
    solved = states.where(F.forall("left", lambda n: n == 0)).groupBy("board").agg(F.sum("ways").alias("solutions"))
    return boards.select("board").join(solved, "board", "left").select("board", F.coalesce("solutions", F.lit(0)).alias("solutions"))


def board_check(targets: DataFrame, arrows: DataFrame) -> DataFrame:
    """``targets(board, id, in_target, out_target)``, ``arrows(board, src, dst)`` -> current counts and whether they match."""
    into = arrows.groupBy("board", F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))
    out = arrows.groupBy("board", F.col("src").alias("id")).agg(F.count("*").alias("outgoing"))
    both = targets.join(into, ["board", "id"], "left").join(out, ["board", "id"], "left")
    i, o = F.coalesce("incoming", F.lit(0)), F.coalesce("outgoing", F.lit(0))
    return both.select("board", "id", i.alias("incoming"), o.alias("outgoing"), ((i == F.col("in_target")) & (o == F.col("out_target"))).alias("fits"))


def board_hint(wires: DataFrame, targets: DataFrame) -> DataFrame:
    """Next wire to set per board. ``wires(board, place, a, b, source, target, pointed)``: ``pointed`` is the end a wire now points to, or null.

    First a wrong wire, else the first unset wire at a socket whose in or out target is reached, else the first unset wire.
    """
    arrows = wires.where("pointed IS NOT NULL").select("board", F.when(F.col("pointed") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("src"), F.col("pointed").alias("dst"))
    now = board_check(targets, arrows).join(targets, ["board", "id"])
    full = now.where("incoming = in_target OR outgoing = out_target").select("board", "id")
    ends = lambda c: full.select("board", F.col("id").alias(c), F.lit(True).alias(f"full_{c}"))
    judged = wires.join(ends("a"), ["board", "a"], "left").join(ends("b"), ["board", "b"], "left")
    wrong, unset = F.col("pointed") != F.col("target"), F.col("pointed").isNull()
    rank = F.when(wrong, 1).when(unset & (F.coalesce("full_a", F.lit(False)) | F.coalesce("full_b", F.lit(False))), 2).when(unset, 3)
    ranked = judged.select("board", "place", "source", "target", rank.alias("kind")).where("kind IS NOT NULL")
    return ranked.groupBy("board").agg(F.min(F.struct("kind", "place", "source", "target")).alias("h")).select("board", "h.kind", "h.place", "h.source", "h.target")


def release_calendar(spark: SparkSession, first: datetime.date, weeks: int, hour: int = 19, zone: str = "Europe/Copenhagen") -> DataFrame:
    """``(week, day, release_utc)``: weekly Wednesdays at a local hour as UTC instants."""
    if first.weekday() != 2:
        raise ValueError("releases fall on Wednesdays")
    if not 0 <= hour <= 23:
        raise ValueError("the hour runs from 0 to 23")
    if not 1 <= weeks <= 260:
        raise ValueError("the number of weeks runs from 1 to 260")
    day = F.date_add(F.lit(first), (F.col("id") * 7).cast("int"))
    local = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {hour:02}:00:00")))
    return spark.range(weeks).select((F.col("id") + 1).cast("int").alias("week"), day.alias("day"), F.to_utc_timestamp(local, zone).alias("release_utc"))


def released(calendar: DataFrame, now: datetime.datetime) -> DataFrame:
    """Weeks released by ``now`` (UTC), with the latest marked."""
    due = calendar.where(F.col("release_utc") <= F.lit(now))
    return due.withColumn("latest", F.col("week") == F.max("week").over(Window.partitionBy()))
