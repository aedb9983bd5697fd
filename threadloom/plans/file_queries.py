"""Loaders and sinks over files that Spark writes from the tables, with DuckDB counterparts on the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import degrees
from threadloom.plans import graph_oracles
from threadloom.session import scratch_path
from threadloom.sources import graphs, tables


def _lines(rows: DataFrame, tag: str, head: list[str], *columns: Column | str) -> str:
    """Folder of tab-separated text files of ``rows``, the lines of ``head`` first."""
    spark = rows.sparkSession
    path = scratch_path(spark, tag)
    body = rows.select(F.concat_ws("\t", *columns).alias("value"))
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).union(body).write.text(path)
    return path


def graph_files(s: SparkSession, d: str) -> DataFrame:
    """Degrees of the link graph of parts after strict loading from a roster file and an arc file."""
    nodes, edges = tables.part_graph(s, d)
    roster = _lines(nodes, "roster", ["# roster", "", "node_id\tname"], "id", "name")
    arcs = _lines(edges, "arcs", ["source\ttarget\tweight", "# arcs"], "src", "dst", "weight")
    loaded = graphs.load_nodes(s, roster)
    return degrees.degree_table(loaded, graphs.load_edges(s, arcs, loaded)).select("id", "in_degree", "out_degree", "degree")


def lax_files(s: SparkSession, d: str) -> DataFrame:
    """What lax loading lets through: arcs with an end that the roster lacks or that repeat, from a file of all part-supplier lines."""
    lines = tables.table(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("long")).alias("w"))
    parts = tables.table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("name"))
    roster = _lines(parts, "roster", ["node_id\tname"], "id", "name")
    nodes = graphs.load_nodes(s, roster, strict=False)
    edges = graphs.load_edges(s, _lines(lines, "arcs", ["source\ttarget"], "a", "b", "w"), nodes, strict=False)
    repeated = graphs.repeated_arcs(edges).agg(F.count("*").alias("repeated"), F.sum("copies").alias("copies"))
    nameless = nodes.agg(F.count(F.when(F.coalesce("name", F.lit("")) == "", 1)).alias("nameless"), F.count("*").alias("nodes"))
    unknown = graphs.unknown_ends(nodes, edges).agg(F.count("*").alias("unknown"))
    return nameless.crossJoin(unknown).crossJoin(repeated).crossJoin(edges.agg(F.sum("weight").alias("weight")))


def json_files(s: SparkSession, d: str) -> DataFrame:
    """Friendship profiles of parts, written as JSON lines and read again; nulls stay."""
    profile = degrees.friendship_profile(*tables.part_graph(s, d)).select("id", "degree", "max_friend", "top_friend", "paradox")
    path = scratch_path(s, "json")
    graphs.write_json(profile, path)
    return s.read.schema(profile.schema).json(path)


QUERIES = {f.__name__: f for f in (graph_files, lax_files, json_files)}

ORACLES = {
    "graph_files": graph_oracles.LINK + " SELECT id::VARCHAR AS id, in_degree, out_degree, degree FROM deg",
    "lax_files": """WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, CASE WHEN l_linenumber > 1 THEN l_quantity::BIGINT ELSE 1 END AS w FROM lineitem),
 n AS (SELECT 'p' || p_partkey AS id, p_size FROM part), r AS (SELECT count(*) AS c FROM e GROUP BY a, b HAVING count(*) > 1)
 SELECT (SELECT count(*) FROM n WHERE p_size <= 5 OR p_size IS NULL) AS nameless, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM (SELECT a AS id FROM e UNION SELECT b FROM e) WHERE id NOT IN (SELECT id FROM n)) AS unknown,
 (SELECT count(*) FROM r) AS repeated, (SELECT sum(c)::BIGINT FROM r) AS copies, (SELECT sum(w)::DOUBLE FROM e) AS weight""",
    "json_files": graph_oracles.LINK + graph_oracles.FRIENDS + " SELECT id, degree, max_friend, top_friend, degree > 0 AND mean_friend > degree AS paradox FROM prof",
}
