"""Graph queries over the link graph of parts and the weighted graph of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import components, cuts, degrees, partitions, paths, removal, weighted
from threadloom.session import materialize
from threadloom.sources import graphs, tables

HUB_STEPS = [0, 1, 3, 5, 10, 20, 40, 80]
PRESETS = [0.05, 0.1, 0.2, 0.3, 0.5, 1.0]
TRIALS = 100


def _und(edges: DataFrame) -> DataFrame:
    return degrees.undirected(edges)


def _order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees.degree_table(nodes, edges)
    return paths.ranked(d, "degree", "place").select("id", "place")


def dup_edges(s: SparkSession, d: str) -> DataFrame:
    lines = tables.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graphs.repeated_arcs(lines)


def unknown_endpoints(s: SparkSession, d: str) -> DataFrame:
    roster = tables.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return graphs.unknown_ends(roster, tables.supplier_graph(s, d)[1])


def degree_table(s: SparkSession, d: str) -> DataFrame:
    return degrees.degree_table(*tables.part_graph(s, d))


def degree_leaders(s: SparkSession, d: str) -> DataFrame:
    t = degree_table(s, d)
    sides = [degrees.leaders(t, m, 10).withColumn("direction", F.lit(n)) for m, n in (("in_degree", "in"), ("out_degree", "out"))]
    return sides[0].union(sides[1]).select("direction", "place", "id", "value")


def degree_distribution(s: SparkSession, d: str) -> DataFrame:
    return degrees.distribution(degree_table(s, d), "in_degree")


def ccdf(s: SparkSession, d: str) -> DataFrame:
    return degrees.ccdf(degree_table(s, d), "in_degree")


def graph_summary(s: SparkSession, d: str) -> DataFrame:
    return degrees.graph_summary(*tables.part_graph(s, d))


def reciprocity(s: SparkSession, d: str) -> DataFrame:
    return degrees.reciprocity(tables.supplier_graph(s, d)[1])


def nonreciprocal_arcs(s: SparkSession, d: str) -> DataFrame:
    return degrees.unanswered_arcs(tables.supplier_graph(s, d)[1])


def same_coordinates(s: SparkSession, d: str) -> DataFrame:
    return degrees.same_coordinates(degree_table(s, d))


def friendship_profile(s: SparkSession, d: str) -> DataFrame:
    return degrees.friendship_profile(*tables.part_graph(s, d))


def friendship_summary(s: SparkSession, d: str) -> DataFrame:
    return degrees.friendship_summary(friendship_profile(s, d))


def versus_pairs(s: SparkSession, d: str) -> DataFrame:
    return degrees.versus_counts(friendship_profile(s, d))


def isolates(s: SparkSession, d: str) -> DataFrame:
    return degrees.isolates(*tables.order_graph(s, d))


def local_degrees(s: SparkSession, d: str) -> DataFrame:
    return degree_table(s, d).where("in_degree <= 20 AND out_degree <= 20").select("id", "in_degree", "out_degree")


def weak_components(s: SparkSession, d: str) -> DataFrame:
    return components.weak_components(*tables.order_graph(s, d))


def giant_subgraph(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.order_graph(s, d)
    ids = components.giant(nodes, components.weak_components(nodes, edges))
    return _und(edges).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def strong_components(s: SparkSession, d: str) -> DataFrame:
    return components.strong_components(*tables.order_graph(s, d))


def distances(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.supplier_graph(s, d)
    return paths.all_distances(nodes, degrees.both_ways(_und(edges)))


def _target(nodes: DataFrame, edges: DataFrame) -> int:
    return degrees.leaders(degrees.degree_table(nodes, edges), "in_degree", 1).first()["id"]


def routes_to_target(s: SparkSession, d: str) -> DataFrame:
    """Reachability of the page with most links in, along arcs and ignoring directions."""
    nodes, edges = tables.part_graph(s, d)
    edges, _ = materialize(edges, "edges")
    t = s.createDataFrame([(_target(nodes, edges),)], "src long")
    n = nodes.agg(F.count("*").alias("n"))
    found = []
    for mode, arcs in (("directed", edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"))), ("undirected", degrees.both_ways(_und(edges)))):
        dist = paths.distances(t, arcs)
        top = dist.agg(F.max("dist").alias("m"))
        far = dist.crossJoin(top).agg(F.count("*").alias("reachable"), F.max("dist").alias("max_distance"), F.count(F.when(F.col("dist") == F.col("m"), 1)).alias("farthest"))
        found.append(far.crossJoin(n).select(F.lit(mode).alias("mode"), "reachable", (F.col("n") - F.col("reachable")).alias("unreachable"), "max_distance", "farthest"))
    return found[0].union(found[1])


def route_text(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.part_graph(s, d)
    edges, _ = materialize(edges, "edges")
    found = paths.routes(_target(nodes, edges), degrees.both_ways(_und(edges)))
    return found.select("node", "dist", F.array_join(F.transform("route", lambda x: x.cast("string")), ">").alias("route"))


def distance_census(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.supplier_graph(s, d)
    return paths.census_of(nodes, paths.distance_counts(degrees.both_ways(_und(edges))))


def _betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return paths.betweenness(nodes, degrees.both_ways(_und(edges)))


def betweenness(s: SparkSession, d: str) -> DataFrame:
    return _betweenness(*tables.supplier_graph(s, d))


def _scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree, betweenness)``, scores at 9 places."""
    b = _betweenness(nodes, edges).select("id", F.round("betweenness", 9).alias("betweenness"))
    return degrees.degree_table(nodes, edges).select("id", "degree").join(b, "id")


def _ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return paths.ranked(paths.ranked(_scores(nodes, edges), "degree", "degree_rank"), "betweenness", "betweenness_rank").select("id", "degree_rank", "betweenness_rank")


def rank_gap(s: SparkSession, d: str) -> DataFrame:
    return _ranks(*tables.supplier_graph(s, d)).withColumn("gap", F.col("degree_rank") - F.col("betweenness_rank"))


def hub_removal(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.order_graph(s, d)
    return removal.hub_removal(_order(nodes, edges), _und(edges), HUB_STEPS)


def single_removal(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.place_graph(s, d)
    return cuts.single_removal(nodes, _und(edges)).join(_ranks(nodes, edges), "id")


def removal_curve(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.supplier_graph(s, d)
    edges, _ = materialize(edges, "edges")
    return removal.removal_curve(_order(nodes, edges).withColumn("trial", F.lit(0)), _und(edges)).select("removed", "giant")


def random_band(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.place_graph(s, d)
    return removal.trial_band(removal.removal_curve(removal.hashed_orders(nodes, TRIALS), _und(edges)))


def _ties(s: SparkSession, d: str) -> DataFrame:
    return weighted.projection(tables.supplier_graph(s, d)[1])


def projection(s: SparkSession, d: str) -> DataFrame:
    return _ties(s, d)


def strength(s: SparkSession, d: str) -> DataFrame:
    return weighted.strengths(_ties(s, d))


def weight_histogram(s: SparkSession, d: str) -> DataFrame:
    return weighted.weight_histogram(_ties(s, d))


def weight_threshold(s: SparkSession, d: str) -> DataFrame:
    return weighted.weight_threshold(_ties(s, d), 12)


def disparity_edges(s: SparkSession, d: str) -> DataFrame:
    return weighted.disparity(_ties(s, d))


def _tails(s: SparkSession, d: str) -> DataFrame:
    """Written once: counts, forests and joining ties all read them."""
    return materialize(disparity_edges(s, d).withColumn("alpha", F.round("alpha", 9)), "tails")[0]


def backbone_presets(s: SparkSession, d: str) -> DataFrame:
    return weighted.backbone_metrics(tables.supplier_graph(s, d)[0], _tails(s, d), PRESETS)


def backbone_curve(s: SparkSession, d: str) -> DataFrame:
    return weighted.backbone_metrics(tables.supplier_graph(s, d)[0], _tails(s, d), [k / 100 for k in range(101)])


def backbone_breakpoints(s: SparkSession, d: str) -> DataFrame:
    tails = _tails(s, d)
    return weighted.breakpoints(degrees.both_ways(tails).select("id").distinct(), tails)


def backbone_joins(s: SparkSession, d: str) -> DataFrame:
    tails = _tails(s, d)
    return weighted.critical_ties(degrees.both_ways(tails).select("id").distinct(), tails)


def modularity(s: SparkSession, d: str) -> DataFrame:
    return partitions.modularity(_ties(s, d), tables.supplier_partitions(s, d)[0])


def super_graph(s: SparkSession, d: str) -> DataFrame:
    return partitions.super_graph(_ties(s, d), tables.supplier_partitions(s, d)[0])


def contingency(s: SparkSession, d: str) -> DataFrame:
    return partitions.contingency(*tables.supplier_partitions(s, d))


def nmi(s: SparkSession, d: str) -> DataFrame:
    return partitions.mutual_information(contingency(s, d))


def rand_index(s: SparkSession, d: str) -> DataFrame:
    return partitions.rand_index(contingency(s, d))


def movers(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.supplier_graph(s, d)
    a, b = tables.supplier_partitions(s, d)
    return partitions.movers(a, b, degrees.degree_table(nodes, edges))


def community_sizes(s: SparkSession, d: str) -> DataFrame:
    return partitions.community_sizes(partitions.renumber(tables.supplier_partitions(s, d)[0]))


def community_leaders(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.supplier_graph(s, d)
    return partitions.community_leaders(tables.supplier_partitions(s, d)[0], degrees.degree_table(nodes, edges), nodes)


def neighbor_communities(s: SparkSession, d: str) -> DataFrame:
    found = partitions.neighbor_communities(_ties(s, d), tables.supplier_partitions(s, d)[0])
    return found.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), " "))


def louvain(s: SparkSession, d: str) -> DataFrame:
    return partitions.louvain(_ties(s, d))


def stability(s: SparkSession, d: str) -> DataFrame:
    """Ten runs of the community search."""
    return partitions.stability(_ties(s, d))


def null_model(s: SparkSession, d: str) -> DataFrame:
    return partitions.degree_preserving_null(_ties(s, d), seed=2026)


def alignment(s: SparkSession, d: str) -> DataFrame:
    return partitions.align(*tables.supplier_partitions(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        dup_edges, unknown_endpoints, degree_table, degree_leaders, degree_distribution, ccdf, graph_summary, reciprocity, nonreciprocal_arcs,
        same_coordinates, friendship_profile, friendship_summary, versus_pairs, isolates, local_degrees, weak_components, giant_subgraph,
        strong_components, distances, routes_to_target, route_text, distance_census, betweenness, rank_gap, hub_removal, single_removal,
        removal_curve, random_band, projection, strength, weight_histogram, weight_threshold, disparity_edges, backbone_presets, backbone_curve,
        backbone_breakpoints, backbone_joins, modularity, super_graph, contingency, nmi, rand_index, movers, community_sizes, community_leaders,
        neighbor_communities, louvain, stability, null_model, alignment,
    )
}
