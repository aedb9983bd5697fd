"""Search, lens, vector, puzzle and calendar queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import degrees, views, weighted
from threadloom.plans import graph_oracles
from threadloom.sources import tables

TERMS = ["5", "Supplier#000000003", "supplier", "000000", "zzz", " "]
NAMES = ["12", "Red  Widget", "blue bolt", "small ring", "zzz", "widget"]
PROBES = [(1, 10.0, 20.0, 30.0), (2, 50.0, 50.0, 50.0), (3, 0.0, 0.0, 0.0)]
#: Wednesdays of the orders and their release instants.
CALENDAR = """WITH f AS (SELECT min(o_orderdate)::DATE + ((3 - isodow(min(o_orderdate)) + 7) % 7)::INTEGER AS first, max(o_orderdate)::DATE AS last FROM orders),
 k AS (SELECT first, unnest(range(least(260, 1 + (last - first) // 7))) AS k FROM f), cal AS (SELECT k + 1 AS week, (first + (k * 7)::INTEGER)::DATE AS day, timezone('UTC', timezone('Europe/Copenhagen', (first + (k * 7)::INTEGER)::TIMESTAMP + INTERVAL 19 HOUR)) AS release_utc FROM k)"""


def _values(rows: list[str]) -> str:
    return ", ".join("('" + r.replace("'", "''") + "')" for r in rows)


def _terms(s: SparkSession, rows: list[str]) -> DataFrame:
    return s.createDataFrame([(r,) for r in rows], "term string")


def display_names(s: SparkSession, d: str) -> DataFrame:
    parts = tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(") ("), "p_brand", F.lit(")")).alias("name"))
    return views.display_names(parts)


def node_search(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables.supplier_graph(s, d)
    return views.search(nodes.join(degrees.degree_table(nodes, edges).select("id", "in_degree"), "id"), _terms(s, TERMS))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("name"))


def strict_resolve(s: SparkSession, d: str) -> DataFrame:
    return views.resolve(_parts(s, d), _terms(s, NAMES))


def substring_resolve(s: SparkSession, d: str) -> DataFrame:
    return views.substring_resolve(_parts(s, d), _terms(s, NAMES))


def _tails(s: SparkSession, d: str) -> DataFrame:
    return weighted.disparity(weighted.projection(tables.supplier_graph(s, d)[1])).withColumn("alpha", F.round("alpha", 9))


def lens_view(s: SparkSession, d: str) -> DataFrame:
    return views.lens(tables.supplier_graph(s, d)[0], _tails(s, d), tables.supplier_partitions(s, d)[1], community=1, around=1, below_alpha=0.6)


def preview_sample(s: SparkSession, d: str) -> DataFrame:
    tails = _tails(s, d)
    return views.preview(weighted.strengths(tails), tables.supplier_partitions(s, d)[1], tails, per_group=3, overall=20)


def _points(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return tables.table(s, d, "part").select(key.alias("id"), F.col("p_size").cast("double").alias("x"), (key % 97).cast("double").alias("y"), (key % 89).cast("double").alias("z"))


def vector_walk(s: SparkSession, d: str) -> DataFrame:
    """Customers walk from their nation along their orders; an order's digits give its step, its status the sign."""
    starts = tables.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    o = F.col("o_orderkey")
    steps = tables.table(s, d, "orders").select(
        F.col("o_custkey").alias("id"), o.alias("place"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("sign"), F.lit(2.5).alias("weight"),
        (o % 21 - 10).cast("double").alias("dx"), (o % 13 - 6).cast("double").alias("dy"), (o % 7 - 3).cast("double").alias("dz"),
    )
    return views.walk(starts, steps)


def nearest_points(s: SparkSession, d: str) -> DataFrame:
    return views.nearest_points(_points(s, d), s.createDataFrame(PROBES, "probe long, x double, y double, z double"))


def proximity(s: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.col("x") - F.col("y")).alias("now")
    return _points(s, d).select("id", views.proximity(gap, F.col("x") + F.col("y")).alias("percent"))


def greedy_hint(s: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    palette = tables.table(s, d, "nation").select(key.alias("place"), F.col("n_name").alias("word"), (key - 12).cast("double").alias("dx"), (key % 7 - 3).cast("double").alias("dy"), (key % 5 - 2).cast("double").alias("dz"))
    state = _points(s, d).select("id", "x", "y", "z", (F.col("z") / 2).alias("tx"), F.col("x").alias("ty"), F.col("y").alias("tz"))
    return views.greedy_hint(state, palette)


def goal_stars(s: SparkSession, d: str) -> DataFrame:
    """Orders as attempts: their lines are the moves against a par of three."""
    return tables.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("moves")).select("id", "moves", views.stars(F.col("moves"), F.lit(3)).alias("stars"))


def board_score(s: SparkSession, d: str) -> DataFrame:
    """Orders as boards: their returned lines are the assists."""
    assists = F.count(F.when(F.col("l_returnflag") == "R", 1))
    return tables.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(assists.alias("assists")).select("id", "assists", views.board_stars(F.col("assists")).alias("stars"))


def _wires(s: SparkSession, d: str) -> DataFrame:
    """Boards: the distinct successive parts among an order's lines, loops left out."""
    lines = tables.table(s, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = lines.select(F.col("l_orderkey").alias("board"), F.col("l_partkey").alias("source"), F.lead("l_partkey").over(order).alias("target")).where("source <> target").distinct()
    return steps.select("board", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "source", "target")


def _targets(wires: DataFrame) -> DataFrame:
    ends = wires.select("board", F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(wires.select("board", "source", F.lit(0), F.lit(1)))
    return ends.groupBy("board", "id").agg(F.sum("i").alias("in_target"), F.sum("o").alias("out_target"))


def orientation_counts(s: SparkSession, d: str) -> DataFrame:
    wires = _wires(s, d)
    return views.orientation_counts(wires, _targets(wires))


def board_check(s: SparkSession, d: str) -> DataFrame:
    """With every wire pointed at its larger end."""
    wires = _wires(s, d)
    return views.board_check(_targets(wires), wires.select("board", F.col("a").alias("src"), F.col("b").alias("dst")))


def board_hint(s: SparkSession, d: str) -> DataFrame:
    """With wires whose ends add up to an even number pointed at their larger end, and the others not set."""
    wires = _wires(s, d)
    placed = wires.withColumn("place", F.row_number().over(Window.partitionBy("board").orderBy("a", "b", "source")))
    return views.board_hint(placed.withColumn("pointed", F.when((F.col("a") + F.col("b")) % 2 == 0, F.col("b"))), _targets(wires))


def _calendar(s: SparkSession, d: str) -> DataFrame:
    """Weekly releases from the first Wednesday of the orders to the last, 260 at most."""
    first, last = tables.table(s, d, "orders").agg(F.next_day(F.date_sub(F.min("o_orderdate").cast("date"), 1), "Wed"), F.max("o_orderdate").cast("date")).first()
    return views.release_calendar(s, first, min(260, 1 + (last - first).days // 7))


def release_calendar(s: SparkSession, d: str) -> DataFrame:
    return _calendar(s, d).select("week", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("release_utc", "yyyy-MM-dd HH:mm:ss").alias("release_utc"))


QUERIES = {
    f.__name__: f
    for f in (
        display_names, node_search, strict_resolve, substring_resolve, lens_view, preview_sample, vector_walk, nearest_points, proximity, greedy_hint,
        goal_stars, board_score, orientation_counts, board_check, board_hint, release_calendar,
    )
}

_T = "lower(trim(term))"
_P = "pts AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_partkey % 97)::DOUBLE AS y, (p_partkey % 89)::DOUBLE AS z FROM part)"
_NORM = "regexp_replace(lower(trim({})), '\\s+', ' ', 'g')"
_KEYED = f"""terms AS (SELECT * FROM (VALUES {_values(NAMES)}) t(term)), pn AS (SELECT p_partkey AS id, p_name || ' (' || p_brand || ')' AS name FROM part),
keyed AS (SELECT id, id::VARCHAR AS i, {_NORM.format("name")} AS n, {_NORM.format("regexp_replace(name, '\\s+\\([^()]*\\)$', '')")} AS l FROM pn), q AS (SELECT term, {_NORM.format("replace(term, '_', ' ')")} AS q FROM terms)"""
_W = """w AS (SELECT DISTINCT board, source, target, least(source, target) AS a, greatest(source, target) AS b FROM (SELECT l_orderkey AS board, l_partkey AS source,
 lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lineitem) WHERE source <> target),
tg AS (SELECT board, id, sum(i)::BIGINT AS in_target, sum(o)::BIGINT AS out_target FROM (SELECT board, target AS id, 1 AS i, 0 AS o FROM w UNION ALL SELECT board, source, 0, 1 FROM w) GROUP BY 1, 2)"""

ORACLES = {
    "display_names": """WITH p AS (SELECT p_partkey AS id, p_name || ' (' || p_type || ') (' || p_brand || ')' AS name FROM part), x AS (SELECT id, name, regexp_replace(name, '\\s+\\([^()]*\\)$', '') AS label, trim(regexp_replace(name, '\\s*\\([^()]*\\)', '', 'g')) AS short FROM p)
 SELECT id, label, short, CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN name ELSE short END AS display FROM x""",
    "node_search": graph_oracles.SUPP
    + f""", terms AS (SELECT * FROM (VALUES {_values(TERMS)}) t(term)), m AS (SELECT term, n.id, name, in_degree, CASE WHEN n.id::VARCHAR = {_T} THEN 1 WHEN lower(name) = {_T} THEN 2 WHEN {_T} <> '' AND contains(lower(name), {_T}) THEN 3 END AS tier
 FROM nodes n JOIN deg ON deg.id = n.id, terms) SELECT term, id, name, tier::BIGINT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tier, in_degree DESC, id) AS rn FROM m WHERE tier IS NOT NULL) WHERE rn = 1""",
    "strict_resolve": f"""WITH {_KEYED}, r AS (SELECT term, min(id) FILTER (i = q OR n = q) AS exact, count(*) FILTER (l = q) AS labels, min(id) FILTER (l = q) AS by_label FROM q JOIN keyed ON i = q OR n = q OR l = q GROUP BY 1)
 SELECT term, coalesce(exact, CASE WHEN labels = 1 THEN by_label END) AS id FROM q LEFT JOIN r USING (term)""",
    "substring_resolve": f"""WITH {_KEYED}, r AS (SELECT term, min(id) FILTER (i = q OR n = q) AS exact, count(*) FILTER (contains(n, q)) AS matches, min(id) FILTER (contains(n, q)) AS only_one FROM q JOIN keyed ON i = q OR contains(n, q) GROUP BY 1)
 SELECT term, coalesce(matches, 0) AS matches, coalesce(exact, CASE WHEN matches = 1 THEN only_one END) AS id FROM q LEFT JOIN r USING (term)""",
    "lens_view": graph_oracles.SUPP
    + graph_oracles.PARTS
    + """, k AS (SELECT * FROM tails WHERE alpha < 0.6), kn AS (SELECT a AS id, b AS nbr FROM k UNION SELECT b, a FROM k),
 al AS (SELECT DISTINCT id FROM kn WHERE id IN (SELECT id FROM pb WHERE label = 1) AND (id = 1 OR id IN (SELECT nbr FROM kn WHERE id = 1))) SELECT a, b, weight FROM k WHERE a IN (SELECT id FROM al) AND b IN (SELECT id FROM al)""",
    "preview_sample": graph_oracles.SUPP
    + graph_oracles.PARTS
    + """, ch AS (SELECT id FROM (SELECT stren.id, row_number() OVER (PARTITION BY label ORDER BY strength DESC, stren.id) AS rn FROM stren JOIN pb USING (id)) WHERE rn <= 3 UNION (SELECT id FROM stren ORDER BY strength DESC, id LIMIT 20))
 SELECT a, b, alpha FROM tails WHERE alpha < 0.5 AND a IN (SELECT id FROM ch) AND b IN (SELECT id FROM ch) ORDER BY alpha, a, b LIMIT 500""",
    "vector_walk": """WITH RECURSIVE st AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE WHEN o_orderstatus = 'F' THEN 2.5 ELSE -2.5 END::DOUBLE AS f, (o_orderkey % 21 - 10)::DOUBLE AS dx, (o_orderkey % 13 - 6)::DOUBLE AS dy, (o_orderkey % 7 - 3)::DOUBLE AS dz FROM orders),
 w AS (SELECT c_custkey AS id, 0::BIGINT AS k, c_nationkey::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM customer UNION ALL SELECT w.id, w.k + 1, greatest(-100.0, least(100.0, floor((w.x + f * dx) * 10 + 0.5) / 10))::DOUBLE, greatest(-100.0, least(100.0, floor((w.y + f * dy) * 10 + 0.5) / 10))::DOUBLE,
 greatest(-100.0, least(100.0, floor((w.z + f * dz) * 10 + 0.5) / 10))::DOUBLE FROM w JOIN st ON st.id = w.id AND st.k = w.k + 1) SELECT id, x, y, z FROM (SELECT *, max(k) OVER (PARTITION BY id) AS m FROM w) WHERE k = m""",
    "nearest_points": f"""WITH {_P}, pr AS (SELECT * FROM (VALUES {", ".join(str(p) for p in PROBES)}) t(probe, x, y, z)), d AS (SELECT probe::BIGINT AS probe, pts.id, round(sqrt(pow(pts.x - pr.x, 2) + pow(pts.y - pr.y, 2) + pow(pts.z - pr.z, 2))::DOUBLE, 6) AS distance FROM pts, pr)
 SELECT probe, id, distance, place, greatest(0, least(100, floor(100 - distance + 0.5)))::BIGINT AS percent FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS place FROM d) WHERE place <= 3""",
    "proximity": f"WITH {_P} SELECT id, greatest(0, least(100, floor(100 * (1 - abs(x - y) / (x + y + 15)) + 0.5)))::BIGINT AS percent FROM pts",
    "greedy_hint": f"""WITH {_P}, t AS (SELECT id, n_nationkey AS place, n_name AS word, round(sqrt(pow(z / 2 - x - (n_nationkey - 12), 2) + pow(x - y - (n_nationkey % 7 - 3), 2) + pow(y - z - (n_nationkey % 5 - 2), 2))::DOUBLE, 6) AS distance FROM pts, nation)
 SELECT id, word, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, place) AS rn FROM t) WHERE rn = 1""",
    "goal_stars": "SELECT l_orderkey AS id, count(*) AS moves, CASE WHEN count(*) <= 3 THEN 3 WHEN count(*) <= 5 THEN 2 ELSE 1 END::BIGINT AS stars FROM lineitem GROUP BY 1",
    "board_score": "SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS assists, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 3 WHEN count(*) FILTER (l_returnflag = 'R') <= 2 THEN 2 ELSE 1 END::BIGINT AS stars FROM lineitem GROUP BY 1",
    "orientation_counts": f"""WITH {_W}, nb AS (SELECT board, a, b, row_number() OVER (PARTITION BY board ORDER BY a, b, source) - 1 AS bit FROM w), mk AS (SELECT board, unnest(range((1 << count(*))::BIGINT)) AS mask FROM w GROUP BY 1),
 ht AS (SELECT mk.board, mask, CASE WHEN (mask >> bit) & 1 = 1 THEN b ELSE a END AS id, count(*) AS n FROM mk JOIN nb ON nb.board = mk.board GROUP BY 1, 2, 3),
 ok AS (SELECT mk.board, mk.mask, min(CASE WHEN coalesce(n, 0) = in_target THEN 1 ELSE 0 END) AS fits FROM mk JOIN tg ON tg.board = mk.board LEFT JOIN ht ON ht.board = mk.board AND ht.mask = mk.mask AND ht.id = tg.id GROUP BY 1, 2) SELECT board, sum(fits)::BIGINT AS solutions FROM ok GROUP BY 1""",
    "board_check": f"""WITH {_W} SELECT tg.board, tg.id, coalesce(i, 0) AS incoming, coalesce(o, 0) AS outgoing, coalesce(i, 0) = in_target AND coalesce(o, 0) = out_target AS fits FROM tg
 LEFT JOIN (SELECT board, b AS id, count(*) AS i FROM w GROUP BY 1, 2) x ON x.board = tg.board AND x.id = tg.id LEFT JOIN (SELECT board, a AS id, count(*) AS o FROM w GROUP BY 1, 2) y ON y.board = tg.board AND y.id = tg.id""",
    "board_hint": f"""WITH {_W}, p AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY a, b, source) AS place, CASE WHEN (a + b) % 2 = 0 THEN b END AS pointed FROM w),
 fl AS (SELECT tg.board, tg.id FROM tg LEFT JOIN (SELECT board, b AS id, count(*) AS i FROM p WHERE pointed IS NOT NULL GROUP BY 1, 2) x ON x.board = tg.board AND x.id = tg.id LEFT JOIN (SELECT board, a AS id, count(*) AS o FROM p WHERE pointed IS NOT NULL GROUP BY 1, 2) y ON y.board = tg.board AND y.id = tg.id
 WHERE coalesce(i, 0) = in_target OR coalesce(o, 0) = out_target), r AS (SELECT *, CASE WHEN pointed <> target THEN 1 WHEN pointed IS NULL AND ((board, a) IN (SELECT board, id FROM fl) OR (board, b) IN (SELECT board, id FROM fl)) THEN 2 WHEN pointed IS NULL THEN 3 END AS kind FROM p)
 SELECT board, kind::BIGINT AS kind, place, source, target FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY kind, place) AS rn FROM r WHERE kind IS NOT NULL) WHERE rn = 1""",
    "release_calendar": CALENDAR + " SELECT week, strftime(day, '%Y-%m-%d') AS day, strftime(release_utc, '%Y-%m-%d %H:%M:%S') AS release_utc FROM cal",
}
