"""Filters, folds, set operations and small checks, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.words import title_words, tokens, url_decoded
from threadloom.operators import components, degrees, evidence, partitions, paths, removal, texts, tiles, views
from threadloom.operators.ranks import placed
from threadloom.plans import cross, graph_oracles, graph_queries, text_oracles, text_queries, view_queries
from threadloom.plans.graph_queries import TRIALS
from threadloom.session import materialize
from threadloom.sources import tables


def evidence_filter(s: SparkSession, d: str) -> DataFrame:
    """Shared runs between documents that follow each other in a source."""
    order = placed(tables.table(s, d, "documents").select("source", "doc_id"), "place", "source", "doc_id")
    after = order.select("source", F.col("doc_id").alias("y"), (F.col("place") - 1).alias("place"))
    links = order.withColumnRenamed("doc_id", "x").join(after, ["source", "place"])
    tied = links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return texts.longest_runs_of(tied.where("a <> b"), text_queries._paras(s, d))


def shared_passages(s: SparkSession, d: str) -> DataFrame:
    """Wording of the shared runs of 20 words or more, which meet on seeds of 20 words: shorter common lines bring no documents together."""
    runs = texts.shared_runs(text_queries._paras(s, d), 20)
    return evidence.passages(tables.documents(s, d), runs, gap="\n").select("a", "b", "start", "end", F.sha2("passage", 256).alias("passage"))


def nearest_filter(s: SparkSession, d: str) -> DataFrame:
    """Suppliers whose nearest text is of their nation, two ties away, and whose names hold a 7."""
    nodes, near = text_queries.nearest_and_hops(s, d)[:2]
    names = nodes.select("id", F.lower("name").alias("name"))
    both = near.join(names, "id").join(names.select(F.col("id").alias("neighbor"), F.col("name").alias("other")), "neighbor")
    return both.where((paths.bucket(F.col("dist")) == "2") & (F.contains("name", F.lit("7")) | F.contains("other", F.lit("7")))).select("id", "neighbor", "score")


def target_rank(s: SparkSession, d: str) -> DataFrame:
    """Place of the smallest other supplier of each supplier's nation among all its text scores."""
    nodes, docs, bags = text_queries._supplier_bags(s, d)
    target, _ = materialize(paths.least_at(*paths.folded_distances(nodes, text_queries._place_ways(s, d)), 2), "target")
    both = target.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    scores = texts.scores_of(both, bags).select("a", "b", F.round("score", 9).alias("score"))
    known = target.select("*", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).join(scores, ["a", "b"]).select("id", "other", "score")
    return tiles.places_of(docs, bags, known)


def contingency_fold(s: SparkSession, d: str) -> DataFrame:
    """Nations against remainders, all but the six largest nations folded into -1."""
    left, right = tables.supplier_partitions(s, d)
    sizes = partitions.community_sizes(left).orderBy(F.desc("size"), "label").limit(6).select("label", F.lit(True).alias("large"))
    folded = left.join(F.broadcast(sizes), "label", "left").select("id", F.when(F.col("large"), F.col("label")).otherwise(-1).alias("label"))
    return partitions.contingency(folded, right)


def mask_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """Title words of parts that their types hold too."""
    parts = tables.table(s, d, "part")
    mask = parts.select(F.explode(title_words(F.concat("p_name", F.lit("_"), "p_type"))).alias("word")).distinct()
    return mask.intersect(parts.select(F.explode(tokens(F.col("p_type"))).alias("word")))


def roster_difference(s: SparkSession, d: str) -> DataFrame:
    """Orders without a line, and orders of lines that the roster lacks."""
    roster, used = tables.table(s, d, "orders").select(F.col("o_orderkey").alias("id")), tables.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return roster.exceptAll(used).withColumn("side", F.lit("unused")).union(used.exceptAll(roster).withColumn("side", F.lit("unknown")))


def connectivity(s: SparkSession, d: str) -> DataFrame:
    """Whether each board's wires hang together, directions ignored."""
    found = components.parts_of_groups(view_queries._wires(s, d).select(F.col("board").alias("group"), "a", "b"))
    return found.select(F.col("group").alias("board"), "parts", (F.col("parts") == 1).alias("connected"))


def takeaway(s: SparkSession, d: str) -> DataFrame:
    """Targeted removal by degree and by betweenness against hashed random orders, at every count."""
    nodes, edges = tables.place_graph(s, d)
    scores = graph_queries._scores(nodes, edges)
    orders = [paths.ranked(scores, m, "place").select(F.lit(m).alias("trial"), "id", "place") for m in ("degree", "betweenness")]
    curve = removal.removal_curve(orders[0].union(orders[1]), degrees.undirected(edges))
    wide = curve.groupBy("removed").agg(*(F.max(F.when(F.col("trial") == m, F.col("giant"))).alias(m) for m in ("degree", "betweenness")))
    band = removal.trial_band(removal.removal_curve(removal.hashed_orders(nodes, TRIALS), degrees.undirected(edges)))
    return cross.takeaway(wide, band)


def poisson_tail(s: SparkSession, d: str) -> DataFrame:
    """Shares of parts with as many links in as each observed number or more, beside a Poisson tail of the same mean."""
    degree = graph_queries.degree_table(s, d)
    mean = degree.agg(F.avg("in_degree").alias("mean"))
    first = F.struct(F.exp(-F.col("mean")).alias("term"), F.lit(0.0).alias("below"))
    step = lambda acc, i: F.struct((acc["term"] * F.col("mean") / i).alias("term"), (acc["below"] + acc["term"]).alias("below"))
    below = F.aggregate(F.sequence(F.lit(1), F.col("value").cast("int")), first, step)["below"]
    return degrees.ccdf(degree, "in_degree").crossJoin(F.broadcast(mean)).select(F.col("value").alias("k"), F.col("probability").alias("share"), (1 - below).alias("tail"))


def release_gate(s: SparkSession, d: str) -> DataFrame:
    """Weeks of the calendar that are out by the middle of the orders."""
    now = tables.table(s, d, "orders").agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("o_orderdate").cast("timestamp")) + F.unix_micros(F.max("o_orderdate").cast("timestamp"))) / 2))).first()[0]
    return views.released(view_queries._calendar(s, d), now).select("week", "latest")


def url_round_trip(s: SparkSession, d: str) -> DataFrame:
    names = tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("+%/é "), "p_type").alias("name"))
    coded = names.select("id", "name", F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")).alias("coded"))
    return coded.select("id", "coded", (url_decoded(F.col("coded")) == F.col("name")).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_filter, shared_passages, nearest_filter, target_rank, contingency_fold, mask_vocabulary, roster_difference, connectivity, takeaway,
        poisson_tail, release_gate, url_round_trip,
    )
}

_J = text_oracles._JOINED
_TOK = text_oracles._tokens
ORACLES = {
    "evidence_filter": f"""WITH {text_oracles._paras()}, {text_oracles._runs()}, l AS (SELECT doc_id AS x, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS y FROM documents)
 SELECT a, b, length FROM runs WHERE (a, b) IN (SELECT least(x, y), greatest(x, y) FROM l WHERE y IS NOT NULL)""",
    "nearest_filter": _J
    + f""", {text_oracles._nearest("sc", "SELECT s_suppkey AS id FROM supplier")} SELECT n.id, neighbor, score FROM near n JOIN dists ON src = n.id AND node = neighbor JOIN supplier x ON x.s_suppkey = n.id JOIN supplier y ON y.s_suppkey = neighbor
 WHERE dist = 2 AND (contains(x.s_name, '7') OR contains(y.s_name, '7'))""",
    "target_rank": _J
    + """, m AS (SELECT a AS id, b AS other, score FROM sc UNION ALL SELECT b, a, score FROM sc), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM m),
 t AS (SELECT src AS id, min(node) AS other FROM dists WHERE dist = 2 GROUP BY 1) SELECT id, other, place FROM p JOIN t USING (id, other)""",
    "contingency_fold": """WITH l AS (SELECT s_nationkey::BIGINT AS label FROM supplier GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6) SELECT CASE WHEN s_nationkey IN (SELECT label FROM l) THEN s_nationkey ELSE -1 END::BIGINT AS x, s_suppkey % 5 AS y, count(*) AS n FROM supplier GROUP BY 1, 2""",
    "mask_vocabulary": f"""WITH m AS (SELECT DISTINCT regexp_replace(w, '''s$', '') AS word FROM (SELECT unnest({_TOK("p_name || ' ' || p_type")}) AS w FROM part)), v AS (SELECT DISTINCT unnest({_TOK("p_type")}) AS word FROM part)
 SELECT word FROM m WHERE length(word) >= 2 AND word NOT IN ('and', 'of', 'the', 'for', 'in') INTERSECT SELECT word FROM v""",
    "roster_difference": """SELECT o_orderkey AS id, 'unused' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'unknown' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "connectivity": f"""WITH RECURSIVE {view_queries._W}, e AS (SELECT board, a AS id, b AS nbr FROM w UNION SELECT board, b, a FROM w), r AS (SELECT DISTINCT board, id, id AS x FROM e UNION SELECT r.board, e.nbr, r.x FROM r JOIN e ON e.board = r.board AND e.id = r.id)
 SELECT board, count(DISTINCT c) AS parts, count(DISTINCT c) = 1 AS connected FROM (SELECT board, id, min(x) AS c FROM r GROUP BY 1, 2) GROUP BY 1""",
    "shared_passages": f"""WITH {text_oracles._paras()}, {text_oracles._runs()}, r AS (SELECT a, b, length, list_sum(list_transform(ps[1 : para_a], lambda t: len(t)))::BIGINT AS skipped, para_a, pos_a FROM runs JOIN para_s ON id = a WHERE length >= 20),
 k AS (SELECT a, b, length, (coalesce(skipped, 0) + pos_a)::BIGINT AS g, text, regexp_extract_all(text, {text_oracles._q(text_oracles.word_pattern(text_oracles.LETTER))}) AS ws, string_split_regex(text, {text_oracles._q(text_oracles.word_pattern(text_oracles.LETTER))}) AS gs FROM r JOIN documents ON doc_id = a),
 o AS (SELECT a, b, text, (list_sum(list_transform(gs[1 : g + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1 : g], lambda x: length(x))), 0))::BIGINT AS start,
 (list_sum(list_transform(gs[1 : g + length], lambda x: length(x))) + list_sum(list_transform(ws[1 : g + length], lambda x: length(x))))::BIGINT AS stop FROM k)
 SELECT a, b, start, stop AS "end", sha256(substring(text, start + 1, stop - start)) AS passage FROM o""",
    "url_round_trip": """WITH n AS (SELECT p_partkey AS id, p_name || '+%/é ' || p_type AS name FROM part) SELECT id, url_encode(name) AS coded, url_decode(url_encode(name)) = name AS same FROM n""",
    "takeaway": graph_oracles.PLAC
    + graph_oracles.BFS
    + graph_oracles.SIGMA
    + """, ord AS (SELECT 'degree' AS trial, id, row_number() OVER (ORDER BY degree DESC, id) AS place FROM deg UNION ALL SELECT 'betweenness', id, row_number() OVER (ORDER BY round(betweenness, 9) DESC, id) FROM bet
 UNION ALL """
    + f"SELECT trial::VARCHAR, id, row_number() OVER (PARTITION BY trial ORDER BY md5(trial::VARCHAR || '-' || id::VARCHAR), id) FROM nodes, (SELECT unnest(range({TRIALS})) AS trial))"
    + graph_oracles._states("range((SELECT count(*) + 1 FROM nodes))")
    + """, f AS (SELECT removed, max(giant) FILTER (trial = 'degree') AS dg, max(giant) FILTER (trial = 'betweenness') AS bt, avg(giant) FILTER (trial NOT IN ('degree', 'betweenness')) AS mean FROM curve GROUP BY 1)
 SELECT removed::BIGINT AS removed, CASE WHEN dg <= bt THEN 'degree' ELSE 'betweenness' END AS better, round(mean - least(dg, bt), 9) AS gap FROM f""",
    "poisson_tail": graph_oracles.LINK
    + """, m AS (SELECT avg(in_degree) AS mean, count(*) FILTER (in_degree > 0) AS n FROM deg), v AS (SELECT in_degree AS k, count(*) AS c FROM deg WHERE in_degree > 0 GROUP BY 1)
 SELECT k, round((SELECT sum(c) FROM v w WHERE w.k >= v.k) / n::DOUBLE, 9) AS share, round(1 - (SELECT sum(exp(-mean + i * ln(mean) - lgamma(i + 1))) FROM (SELECT unnest(range(5000)) AS i) WHERE i < v.k), 9) AS tail FROM v, m""",
    "release_gate": view_queries.CALENDAR
    + """, o AS (SELECT make_timestamp((epoch_us(min(o_orderdate)) + epoch_us(max(o_orderdate))) // 2) AS middle FROM orders) SELECT week, week = max(week) OVER () AS latest FROM cal, o WHERE release_utc <= middle""",
}
