"""Graphs and corpora read off the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _arcs(steps: DataFrame) -> DataFrame:
    return steps.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def successions(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """``(src, dst, weight)``: how often ``key`` follows itself within an order's lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return _arcs(table(spark, sf_dir, "lineitem").select(F.col(key).alias("src"), F.lead(key).over(order).alias("dst")))


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return nodes, successions(spark, sf_dir, "l_partkey")


def supplier_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return nodes, successions(spark, sf_dir, "l_suppkey")


def place_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, nations and regions, and an arc from each to the place it belongs to; nations count down from -1000, regions from -1."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    nation = lambda c: (-1000 - F.col(c)).cast("long")
    region = lambda c: (-1 - F.col(c)).cast("long")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).union(n.select(nation("n_nationkey"), "n_name")).union(r.select(region("r_regionkey"), "r_name"))
    steps = s.select(F.col("s_suppkey").alias("src"), nation("s_nationkey").alias("dst")).union(n.select(nation("n_nationkey"), region("n_regionkey")))
    return nodes, _arcs(steps)


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and an arc from each to the next order of the same part from the same supplier."""
    order = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.lead("l_orderkey").over(order).alias("dst"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), _arcs(steps)


def supplier_partitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("label")), s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("label"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
