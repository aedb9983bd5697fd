"""Strict graph loading from tab-separated files, JSON snapshots and bundles, with provenance hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import materialize


def content_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(fields, place)`` of a tab-separated file or a folder of such, ``place`` in file order: byte-order mark, blank lines and ``#`` lines dropped."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place")
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "").alias("line"), place)
    kept = lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    return kept.select(F.split("line", "\t").alias("fields"), "place")


def _fail(found: DataFrame, what: str) -> None:
    bad = [str(r[0]) for r in found.limit(10).collect()]
    if bad:
        raise ValueError(f"{what}: {', '.join(bad)}")


def load_nodes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The roster with its header's columns; ``node_id`` becomes ``id``. Strict loading raises on any malformed row."""
    rows = content_rows(spark, path)
    head = rows.agg(F.min(F.struct("place", "fields")).alias("m")).select("m.*").first()
    head = None if head["fields"] is None else head
    if head is None or not {"node_id", "name"} <= set(head.fields):
        raise ValueError("the header must hold node_id and name")
    columns = list(head.fields)
    same = [F.col(f"place.{c}") == head.place[c] for c in ("file", "block", "line")]
    body = rows.where(~(same[0] & same[1] & same[2]))
    if strict:
        _fail(body.where(F.size("fields") != len(columns)).select(F.array_join("fields", "|")), "rows of the wrong width")
    nodes = body.select(*(F.trim(F.get("fields", F.lit(i))).alias("id" if c == "node_id" else c) for i, c in enumerate(columns)))
    if strict:
        check_nodes(nodes)
    return nodes


def check_nodes(nodes: DataFrame) -> None:
    if nodes.isEmpty():
        raise ValueError("the roster is empty")
    _fail(nodes.where("coalesce(id, '') = '' OR coalesce(name, '') = ''").select(F.concat_ws("|", "id", "name")), "rows without id or name")
    _fail(nodes.groupBy("id").count().where("count > 1").select("id"), "repeated ids")


def load_edges(spark: SparkSession, path: str, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """``(src, dst, weight)``; an optional ``source, target`` header is skipped, a third column is the weight (1 by default)."""
    rows = content_rows(spark, path)
    body = rows.where(~((F.lower(F.get("fields", F.lit(0))) == "source") & (F.lower(F.get("fields", F.lit(1))) == "target")))
    if strict:
        _fail(body.where(~F.size("fields").isin(2, 3)).select(F.array_join("fields", "|")), "arcs of the wrong width")
    edges = body.select(F.trim(F.get("fields", F.lit(0))).alias("src"), F.trim(F.get("fields", F.lit(1))).alias("dst"), F.coalesce(F.get("fields", F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))
    if strict:
        edges, _ = materialize(edges, "arcs")  # the checks and the caller read columns instead of lines
        check_edges(nodes, edges)
    return edges


def unknown_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ends of arcs that the roster doesn't hold."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def repeated_arcs(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("copies")).where("copies > 1")


def check_edges(nodes: DataFrame, edges: DataFrame) -> None:
    _fail(unknown_ends(nodes, edges), "arcs to unknown ids")
    _fail(repeated_arcs(edges).select(F.concat_ws(" -> ", "src", "dst")), "repeated arcs")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Roster and arcs of a nested page snapshot: links between its own pages, without loops, once each."""
    pages = spark.read.json(path, multiLine=True).select(F.explode("pages").alias("p"))
    nodes = pages.select(F.col("p.title").alias("id"), F.col("p.title").alias("name"), F.col("p.url").alias("url"))
    links = pages.select(F.col("p.title").alias("src"), F.explode("p.links").alias("dst")).where("src <> dst").distinct()
    return nodes, links.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def load_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A ``window.NAME = {...};`` file as one row of its JSON record."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)^\s*window\.\w+\s*=\s*", "").alias("value"))
    return spark.read.json(text.select(F.regexp_replace("value", r"(?s);\s*$", "").alias("value")).rdd.map(lambda r: r.value))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of the exact input files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept, existing output replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
