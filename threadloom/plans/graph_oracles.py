"""DuckDB counterparts of the graph queries."""

from __future__ import annotations

from threadloom.plans.graph_queries import HUB_STEPS, PRESETS, TRIALS


LINE_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey"


def _successions(key: str, order: str = LINE_ORDER) -> str:
    return f"SELECT {key} AS src, lead({key}) OVER ({order}) AS dst FROM lineitem"


def _graph(steps: str, roster: str) -> str:
    return f"""WITH RECURSIVE edges AS (SELECT src, dst, count(*) AS weight FROM ({steps}) WHERE dst IS NOT NULL GROUP BY 1, 2), nodes AS ({roster}),
ties AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight)::BIGINT AS weight FROM edges WHERE src <> dst GROUP BY 1, 2), und AS (SELECT a, b FROM ties),
adj AS (SELECT a AS id, b AS nbr FROM und UNION ALL SELECT b, a FROM und),
deg AS (SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS total_degree, coalesce(u.c, 0) AS degree
 FROM nodes n LEFT JOIN (SELECT dst, count(*) c FROM edges GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) c FROM edges GROUP BY 1) o ON o.src = n.id
 LEFT JOIN (SELECT id, count(*) c FROM adj GROUP BY 1) u ON u.id = n.id),
ends AS (SELECT a AS id, b AS nbr, weight FROM ties UNION ALL SELECT b, a, weight FROM ties),
stren AS (SELECT id, sum(weight)::BIGINT AS strength, count(*) AS k FROM ends GROUP BY 1),
tails AS (SELECT a, b, t.weight, round(least(CASE WHEN sa.k = 1 THEN 1.0 ELSE pow(1 - t.weight / sa.strength, sa.k - 1) END,
 CASE WHEN sb.k = 1 THEN 1.0 ELSE pow(1 - t.weight / sb.strength, sb.k - 1) END)::DOUBLE, 9) AS alpha FROM ties t JOIN stren sa ON sa.id = a JOIN stren sb ON sb.id = b)"""


_SUPPLIERS = "SELECT s_suppkey AS id, s_name AS name FROM supplier"
LINK = _graph(_successions("l_partkey"), "SELECT p_partkey AS id, p_name AS name FROM part")
SUPP = _graph(_successions("l_suppkey"), _SUPPLIERS)
ORDS = _graph(_successions("l_orderkey", "PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber"), "SELECT o_orderkey AS id FROM orders")
PLAC = _graph(
    "SELECT s_suppkey AS src, (-1000 - s_nationkey)::BIGINT AS dst FROM supplier UNION ALL SELECT (-1000 - n_nationkey)::BIGINT, (-1 - n_regionkey)::BIGINT FROM nation",
    _SUPPLIERS + " UNION ALL SELECT (-1000 - n_nationkey)::BIGINT, n_name FROM nation UNION ALL SELECT (-1 - r_regionkey)::BIGINT, r_name FROM region",
)
PARTS = ", pa AS (SELECT s_suppkey AS id, s_nationkey::BIGINT AS label FROM supplier), pb AS (SELECT s_suppkey AS id, s_suppkey % 5 AS label FROM supplier)"
CONT = PARTS + ", cont AS (SELECT pa.label AS x, pb.label AS y, count(*) AS n FROM pa JOIN pb USING (id) GROUP BY 1, 2)"
WCC = """, comp(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION
 SELECT n.nbr, min(c.component) FROM comp c JOIN adj n ON n.id = c.id JOIN recurring.comp r ON r.id = n.nbr WHERE c.component < r.component GROUP BY n.nbr)"""
#: The smallest alpha at which two nodes hang together, and the events of the filter's tightening.
MINIMAX = """, mm(src, node, best) USING KEY (src, node) AS (SELECT id, id, -1.0::DOUBLE FROM stren UNION
 SELECT m.src, x.nbr, min(greatest(m.best, t.alpha)) FROM mm m JOIN ends x ON x.id = m.node JOIN tails t ON t.a = least(x.id, x.nbr) AND t.b = greatest(x.id, x.nbr)
 LEFT JOIN recurring.mm k ON k.src = m.src AND k.node = x.nbr WHERE greatest(m.best, t.alpha) < coalesce(k.best, 2) GROUP BY 1, 2),
 nn AS (SELECT count(*) AS n FROM stren), ord AS (SELECT src, best, row_number() OVER (PARTITION BY src ORDER BY best) AS rn FROM mm),
 ev AS (SELECT 'first_fragmentation' AS event, min(best) AS alpha FROM ord, nn WHERE rn = n AND n > 1 HAVING count(*) > 0 UNION ALL SELECT 'half_giant', min(best) FROM ord, nn WHERE rn = ceil(n / 2) AND n > 2 HAVING count(*) > 0)"""
FRIENDS = """, prof AS (SELECT n.id, d.degree, coalesce(avg(f.degree), 0.0) AS mean_friend, coalesce(max(f.degree), 0) AS max_friend, arg_min(f.id, (-f.degree, f.id)) AS top_friend
 FROM nodes n JOIN deg d ON d.id = n.id LEFT JOIN adj ON adj.id = n.id LEFT JOIN deg f ON f.id = adj.nbr GROUP BY n.id, d.degree)"""
BFS = """, walk AS (SELECT id AS src, id AS node, 0 AS dist FROM nodes UNION SELECT w.src, n.nbr, w.dist + 1 FROM walk w JOIN adj n ON n.id = w.node WHERE w.dist < 12),
dists AS (SELECT src, node, min(dist) AS dist FROM walk GROUP BY 1, 2)"""
SIGMA = """, sig AS (SELECT id AS src, id AS node, 0 AS dist, 1.0::DOUBLE AS paths FROM nodes UNION ALL
 SELECT s.src, d.node, s.dist + 1, sum(s.paths)::DOUBLE FROM sig s JOIN adj n ON n.id = s.node JOIN dists d ON d.src = s.src AND d.node = n.nbr AND d.dist = s.dist + 1 GROUP BY 1, 2, 3),
bet AS (SELECT v.id, CASE WHEN (SELECT count(*) FROM nodes) <= 2 THEN 0.0 ELSE coalesce(raw, 0) / (((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2)) END AS betweenness
 FROM nodes v LEFT JOIN (SELECT x.node AS id, sum(x.paths * y.paths / w.paths) AS raw FROM sig x JOIN sig y ON y.src = x.node JOIN sig w ON w.src = x.src AND w.node = y.node AND w.dist = x.dist + y.dist
 WHERE x.dist > 0 AND y.dist > 0 AND x.src <> y.node GROUP BY 1) r ON r.id = v.id)"""
ORDER = ", ord AS (SELECT 0 AS trial, id, row_number() OVER (ORDER BY degree DESC, id) AS place FROM deg)"


def _states(steps: str, order: str = "ord") -> str:
    return f""", st AS (SELECT trial, n, k AS removed FROM (SELECT trial, count(*) AS n FROM {order} GROUP BY 1), (SELECT unnest({steps}) AS k)),
kept AS (SELECT s.trial, s.removed, o.id FROM st s JOIN {order} o ON o.trial = s.trial AND o.place > s.removed),
sreach(trial, removed, id, r) USING KEY (trial, removed, id) AS (SELECT trial, removed, id, id FROM kept UNION
 SELECT x.trial, x.removed, n.nbr, min(x.r) FROM sreach x JOIN adj n ON n.id = x.id JOIN recurring.sreach k ON k.trial = x.trial AND k.removed = x.removed AND k.id = n.nbr WHERE x.r < k.r GROUP BY 1, 2, 3),
sgiant AS (SELECT trial, removed, max(c) AS giant FROM (SELECT trial, removed, r, count(*) AS c FROM sreach GROUP BY 1, 2, 3) GROUP BY 1, 2),
curve AS (SELECT s.trial, s.removed, s.n, coalesce(giant, 0) AS giant, s.n - s.removed AS remaining FROM st s LEFT JOIN sgiant g USING (trial, removed))"""


def _levels(levels: list[float]) -> str:
    return f""", lev AS (SELECT unnest([{", ".join(f"{x:.2f}::DOUBLE" for x in levels)}]) AS level),
bk AS (SELECT level, a, b FROM tails, lev WHERE level >= 1 OR alpha < level), bn AS (SELECT level, a AS id, b AS nbr FROM bk UNION ALL SELECT level, b, a FROM bk),
br(level, id, r) USING KEY (level, id) AS (SELECT DISTINCT level, id, id FROM bn UNION
 SELECT x.level, bn.nbr, min(x.r) FROM br x JOIN bn ON bn.level = x.level AND bn.id = x.id JOIN recurring.br k ON k.level = x.level AND k.id = bn.nbr WHERE x.r < k.r GROUP BY 1, 2),
bs AS (SELECT level, max(c) AS giant, count(*) AS parts FROM (SELECT level, r, count(*) AS c FROM br GROUP BY 1, 2) GROUP BY 1),
bt AS (SELECT level, count(*) AS ties FROM bk GROUP BY 1), bu AS (SELECT level, count(DISTINCT id) AS touched FROM bn GROUP BY 1)
SELECT level AS alpha, coalesce(ties, 0) AS ties, coalesce(touched, 0) AS nodes, coalesce(giant, 0) AS giant, (SELECT count(*) FROM nodes) - coalesce(touched, 0) + coalesce(parts, 0) AS components,
 round(coalesce(ties, 0) / (SELECT count(*) FROM ties)::DOUBLE, 9) AS tie_share, round(coalesce(touched, 0) / (SELECT count(*) FROM nodes)::DOUBLE, 9) AS node_share,
 round(coalesce(giant, 0) / (SELECT count(*) FROM nodes)::DOUBLE, 9) AS giant_share FROM lev LEFT JOIN bt USING (level) LEFT JOIN bu USING (level) LEFT JOIN bs USING (level)"""


_ROUTES = """, target AS (SELECT id FROM deg ORDER BY in_degree DESC, id LIMIT 1)"""
_MODES = (
    _ROUTES
    + """, ways AS (SELECT 'directed' AS mode, dst AS id, src AS nbr FROM edges UNION ALL SELECT 'undirected', id, nbr FROM adj),
w AS (SELECT m AS mode, id AS node, 0 AS dist FROM target, (SELECT unnest(['directed', 'undirected']) AS m) UNION SELECT w.mode, a.nbr, w.dist + 1 FROM w JOIN ways a ON a.mode = w.mode AND a.id = w.node WHERE w.dist < 40),
dd AS (SELECT mode, node, min(dist) AS dist FROM w GROUP BY 1, 2)
SELECT mode, count(*) AS reachable, (SELECT count(*) FROM nodes) - count(*) AS unreachable, max(dist)::BIGINT AS max_distance, count(*) FILTER (dist = m) AS farthest
FROM (SELECT *, max(dist) OVER (PARTITION BY mode) AS m FROM dd) GROUP BY mode"""
)
_TEXT = (
    _ROUTES
    + """, w AS (SELECT id AS node, 0 AS dist FROM target UNION SELECT n.nbr, w.dist + 1 FROM w JOIN adj n ON n.id = w.node WHERE w.dist < 40),
dd AS (SELECT node, min(dist) AS dist FROM w GROUP BY 1),
p AS (SELECT id AS node, 0 AS dist, [id] AS route FROM target UNION ALL SELECT d.node, d.dist, min(list_append(p.route, d.node)) FROM p JOIN adj n ON n.id = p.node JOIN dd d ON d.node = n.nbr AND d.dist = p.dist + 1 GROUP BY 1, 2)
SELECT node, dist::BIGINT AS dist, array_to_string(list_transform(route, lambda x: x::VARCHAR), '>') AS route FROM p"""
)
_RECIP = """, loopless AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), rc AS (SELECT count(*) AS arcs, count(b.src) AS reciprocal_arcs FROM loopless a LEFT JOIN loopless b ON a.src = b.dst AND a.dst = b.src)"""

ORACLES = {
    "dup_edges": "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "unknown_endpoints": SUPP + " SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "degree_table": LINK + " SELECT id, in_degree, out_degree, total_degree, degree FROM deg",
    "degree_leaders": LINK
    + """ SELECT direction, place, id, value FROM (SELECT 'in' AS direction, row_number() OVER (ORDER BY in_degree DESC, id) AS place, id, in_degree AS value FROM deg
 UNION ALL SELECT 'out', row_number() OVER (ORDER BY out_degree DESC, id), id, out_degree FROM deg) WHERE place <= 10""",
    "degree_distribution": LINK + " SELECT in_degree AS value, count(*) AS nodes, round(count(*) / (SELECT count(*) FROM nodes)::DOUBLE, 9) AS probability FROM deg GROUP BY 1",
    "ccdf": LINK
    + """ SELECT value, at_least::BIGINT AS at_least, round(at_least / total::DOUBLE, 9) AS probability FROM (SELECT in_degree AS value, sum(count(*)) OVER (ORDER BY in_degree DESC) AS at_least, sum(count(*)) OVER () AS total
 FROM deg WHERE in_degree > 0 GROUP BY 1)""",
    "graph_summary": LINK
    + _RECIP
    + """ SELECT count(*) AS nodes, sum(out_degree)::BIGINT AS arcs, count(*) FILTER (total_degree = 0) AS isolates, round(avg(in_degree), 9) AS mean_in, median(in_degree)::DOUBLE AS median_in, median(out_degree)::DOUBLE AS median_out,
 count(*) FILTER (in_degree = 0) AS zero_in, count(*) FILTER (out_degree = 0) AS zero_out, (SELECT count(*) FROM edges WHERE src = dst) AS loops, (SELECT reciprocal_arcs FROM rc) AS reciprocal_arcs,
 (SELECT reciprocal_arcs // 2 FROM rc) AS reciprocal_pairs, (SELECT round(reciprocal_arcs / nullif(arcs, 0)::DOUBLE, 9) FROM rc) AS reciprocity FROM deg""",
    "reciprocity": SUPP + _RECIP + " SELECT arcs, reciprocal_arcs, reciprocal_arcs // 2 AS pairs, round(reciprocal_arcs / nullif(arcs, 0)::DOUBLE, 9) AS reciprocity FROM rc",
    "nonreciprocal_arcs": SUPP + " SELECT DISTINCT src, dst FROM edges e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM edges f WHERE f.src = e.dst AND f.dst = e.src)",
    "same_coordinates": LINK + " SELECT id, in_degree, out_degree, count(*) OVER (PARTITION BY in_degree, out_degree) AS sharing FROM deg",
    "friendship_profile": LINK
    + FRIENDS
    + """ SELECT id, degree, round(mean_friend, 9) AS mean_friend, max_friend, top_friend, degree > 0 AND mean_friend > degree AS paradox, degree > 0 AND degree >= mean_friend AS beats_paradox, degree > 0 AND degree >= max_friend AS undefeated FROM prof""",
    "friendship_summary": LINK
    + FRIENDS
    + """ SELECT count(*) FILTER (degree > 0) AS connected, count(*) FILTER (degree > 0 AND mean_friend > degree) AS in_paradox, round(count(*) FILTER (degree > 0 AND mean_friend > degree) / nullif(count(*) FILTER (degree > 0), 0)::DOUBLE, 9) AS share,
 round(avg(degree), 9) AS mean_degree, round(sum(degree * degree) / nullif(sum(degree), 0)::DOUBLE, 9) AS edge_end_mean FROM prof""",
    "versus_pairs": LINK
    + FRIENDS
    + """, pool AS (SELECT id, round(mean_friend, 6) AS m FROM prof WHERE degree >= 2), lv AS (SELECT m, count(*) AS n FROM pool GROUP BY 1),
 op AS (SELECT x.m, coalesce(sum(y.n), 0)::BIGINT AS opponents FROM lv x LEFT JOIN lv y ON y.m <= round(x.m - 0.8, 6) OR y.m >= round(x.m + 0.8, 6) GROUP BY 1)
 SELECT id, m AS mean_friend, opponents FROM pool JOIN op USING (m)""",
    "isolates": ORDS + " SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "local_degrees": LINK + " SELECT id, in_degree, out_degree FROM deg WHERE in_degree <= 20 AND out_degree <= 20",
    "weak_components": ORDS + WCC + " SELECT id, component FROM comp",
    "giant_subgraph": ORDS + WCC + ", top AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT a, b FROM und JOIN comp ON comp.id = a JOIN top USING (component)",
    "strong_components": ORDS
    + """, dr AS (SELECT id AS s, id AS v FROM nodes UNION SELECT dr.s, e.dst FROM dr JOIN edges e ON e.src = dr.v)
 SELECT x.s AS id, min(x.v) AS component FROM dr x JOIN dr y ON y.s = x.v AND y.v = x.s GROUP BY 1""",
    "distances": SUPP + BFS + " SELECT src, node, dist::BIGINT AS dist FROM dists",
    "routes_to_target": LINK + _MODES,
    "route_text": LINK + _TEXT,
    "distance_census": SUPP
    + BFS
    + """, allp AS (SELECT (count(*) * (count(*) - 1) // 2)::BIGINT AS n FROM nodes), bk AS (SELECT unnest(['1', '2', '3', '4+', 'disconnected']) AS bucket),
 c AS (SELECT CASE WHEN dist >= 4 THEN '4+' ELSE dist::VARCHAR END AS bucket, count(*) AS pairs FROM dists WHERE src < node GROUP BY 1 UNION ALL SELECT 'disconnected', (SELECT n FROM allp) - (SELECT count(*) FROM dists WHERE src < node))
 SELECT bucket, coalesce(pairs, 0) AS pairs, round(coalesce(pairs, 0) / nullif((SELECT n FROM allp), 0)::DOUBLE, 9) AS share FROM bk LEFT JOIN c USING (bucket)""",
    "betweenness": SUPP + BFS + SIGMA + " SELECT id, round(betweenness, 9) AS betweenness FROM bet",
    "rank_gap": SUPP
    + BFS
    + SIGMA
    + """ SELECT id, degree_rank, betweenness_rank, degree_rank - betweenness_rank AS gap FROM (SELECT deg.id, row_number() OVER (ORDER BY degree DESC, deg.id) AS degree_rank,
 row_number() OVER (ORDER BY round(betweenness, 9) DESC, deg.id) AS betweenness_rank FROM deg JOIN bet ON bet.id = deg.id)""",
    "hub_removal": ORDS
    + ORDER
    + _states(str(HUB_STEPS))
    + " SELECT removed::BIGINT AS removed, giant, round(giant / n::DOUBLE, 9) AS share_of_original, round(giant / remaining::DOUBLE, 9) AS share_of_remaining FROM curve WHERE removed < n",
    "single_removal": PLAC
    + WCC
    + BFS
    + SIGMA
    + """, top AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), kp AS (SELECT g.id AS gone, n.id FROM nodes g, nodes n WHERE g.id <> n.id),
 gr(gone, id, c) USING KEY (gone, id) AS (SELECT gone, id, id FROM kp UNION SELECT x.gone, n.nbr, min(x.c) FROM gr x JOIN adj n ON n.id = x.id JOIN recurring.gr k ON k.gone = x.gone AND k.id = n.nbr WHERE x.c < k.c GROUP BY 1, 2), gc AS (SELECT gone, id, c FROM gr),
 pt AS (SELECT gone, c, count(*) AS size, count(*) FILTER (comp.component = (SELECT component FROM top)) AS held FROM gc JOIN comp ON comp.id = gc.id GROUP BY 1, 2),
 af AS (SELECT gone, max(size) AS giant_after, count(*) AS components, sum(held) - max(held) AS detached FROM pt GROUP BY 1),
 rk AS (SELECT deg.id, row_number() OVER (ORDER BY degree DESC, deg.id) AS degree_rank, row_number() OVER (ORDER BY round(betweenness, 9) DESC, deg.id) AS betweenness_rank FROM deg JOIN bet ON bet.id = deg.id)
 SELECT n.id, coalesce(giant_after, 0) AS giant_after, coalesce(components, 0) AS components, coalesce(components, 0) - (SELECT count(DISTINCT component) FROM comp) AS extra_components, coalesce(detached, 0)::BIGINT AS detached, degree_rank, betweenness_rank
 FROM nodes n JOIN rk USING (id) LEFT JOIN af ON af.gone = n.id""",
    "removal_curve": SUPP + ORDER + _states("range((SELECT count(*) + 1 FROM nodes))") + " SELECT removed::BIGINT AS removed, giant FROM curve",
    "random_band": PLAC
    + f", ord AS (SELECT trial, id, row_number() OVER (PARTITION BY trial ORDER BY md5(trial::VARCHAR || '-' || id::VARCHAR), id) AS place FROM nodes, (SELECT unnest(range({TRIALS})) AS trial))"
    + _states("range((SELECT count(*) + 1 FROM nodes))")
    + """, lst AS (SELECT removed, avg(giant) AS mean, list_sort(list(giant)) AS g FROM curve GROUP BY 1)
 SELECT removed::BIGINT AS removed, round(mean, 9) AS mean, g[1 + floor((len(g) - 1) * 0.05)::BIGINT] AS p05, g[1 + ceil((len(g) - 1) * 0.95)::BIGINT] AS p95 FROM lst""",
    "projection": SUPP + " SELECT a, b, weight FROM ties",
    "strength": SUPP + " SELECT id, strength, k AS degree FROM stren",
    "weight_histogram": SUPP + " SELECT weight, count(*) AS ties FROM ties GROUP BY 1",
    "weight_threshold": SUPP + " SELECT (SELECT count(*) FROM ties WHERE weight >= 12) AS ties, (SELECT count(DISTINCT id) FROM ends WHERE weight >= 12) AS nodes",
    "disparity_edges": SUPP + " SELECT a, b, weight, alpha FROM tails",
    "backbone_presets": SUPP + _levels(PRESETS),
    "backbone_curve": SUPP + _levels([k / 100 for k in range(101)]),
    "modularity": SUPP
    + PARTS
    + """, m AS (SELECT sum(weight)::DOUBLE AS m FROM ties), i AS (SELECT x.label, sum(weight) AS w FROM ties JOIN pa x ON x.id = a JOIN pa y ON y.id = b WHERE x.label = y.label GROUP BY 1),
 h AS (SELECT label, sum(strength)::DOUBLE AS k FROM stren JOIN pa USING (id) GROUP BY 1) SELECT round(coalesce(sum(coalesce(w, 0) / m - pow(k / (2 * m), 2)), 0), 9) AS modularity FROM h LEFT JOIN i USING (label), m""",
    "super_graph": SUPP + PARTS + " SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, sum(weight)::BIGINT AS weight FROM ties JOIN pa x ON x.id = a JOIN pa y ON y.id = b GROUP BY 1, 2",
    "contingency": SUPP + CONT + " SELECT x, y, n FROM cont",
    "nmi": SUPP
    + CONT
    + """, t AS (SELECT sum(n)::DOUBLE AS t FROM cont), nx AS (SELECT x, sum(n) AS c FROM cont GROUP BY 1), ny AS (SELECT y, sum(n) AS c FROM cont GROUP BY 1),
 h AS (SELECT (SELECT -sum(c / t * ln(c / t)) FROM nx, t) AS hx, (SELECT -sum(c / t * ln(c / t)) FROM ny, t) AS hy, (SELECT sum(n / t * ln(n * t / (nx.c * ny.c))) FROM cont JOIN nx USING (x) JOIN ny USING (y), t) AS i)
 SELECT CASE WHEN coalesce(hx + hy, 0) <= 0 THEN 1.0 ELSE round(least(1, greatest(0, 2 * i / (hx + hy))), 9) END AS nmi FROM h""",
    "rand_index": SUPP
    + CONT
    + """, q AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM cont) AS b, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT sum(n) AS c FROM cont GROUP BY x)) AS px, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT sum(n) AS c FROM cont GROUP BY y)) AS py,
 (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM cont) AS e) SELECT CASE WHEN e > 0 THEN round(((e + 2 * b - px - py) / e)::DOUBLE, 9) ELSE 1.0 END AS rand FROM q""",
    "movers": SUPP + PARTS + " SELECT pa.id, pa.label AS before, pb.label AS after, coalesce(degree, 0) AS degree FROM pa JOIN pb USING (id) LEFT JOIN deg USING (id) WHERE pa.label <> pb.label",
    "community_sizes": SUPP
    + PARTS
    + " SELECT row_number() OVER (ORDER BY size DESC, first) - 1 AS label, size FROM (SELECT label, count(*) AS size, min(id) AS first FROM pa GROUP BY 1)",
    "community_leaders": SUPP
    + PARTS
    + """, rk AS (SELECT pa.label, pa.id, name, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY label ORDER BY degree DESC, name, id) AS place, count(*) OVER (PARTITION BY label) AS size FROM pa JOIN nodes USING (id) LEFT JOIN deg USING (id))
 SELECT label, size, place, id, name, degree, (SELECT string_agg(name, ' · ' ORDER BY place) FROM rk y WHERE y.label = rk.label AND y.place <= 2) AS title FROM rk WHERE place <= 5""",
    "neighbor_communities": SUPP + PARTS + " SELECT ends.id, pa.label, count(*) AS neighbors, sum(weight)::BIGINT AS weight, string_agg(nbr::VARCHAR, ' ' ORDER BY weight DESC, nbr) AS members FROM ends JOIN pa ON pa.id = nbr GROUP BY 1, 2",
    "backbone_breakpoints": SUPP
    + MINIMAX
    + """, j AS (SELECT ev.event, count(*) AS c FROM ev JOIN tails t ON t.alpha = ev.alpha JOIN mm ON mm.src = t.a AND mm.node = t.b WHERE mm.best >= ev.alpha GROUP BY 1)
 SELECT event, alpha, (SELECT max(c) FROM (SELECT count(*) AS c FROM mm WHERE best <= alpha GROUP BY src)) AS giant_looser, (SELECT max(c) FROM (SELECT count(*) AS c FROM mm WHERE best < alpha GROUP BY src)) AS giant_stricter,
 (SELECT count(*) FROM tails t WHERE t.alpha = ev.alpha) AS removed_ties, c AS joining_ties FROM ev JOIN j USING (event)""",
    "backbone_joins": SUPP
    + MINIMAX
    + """, sz AS (SELECT event, src, count(*) FILTER (best < alpha) AS c FROM ev, mm GROUP BY 1, 2),
 j AS (SELECT ev.event, t.a, t.b, x.c AS size_a, y.c AS size_b FROM ev JOIN tails t ON t.alpha = ev.alpha JOIN mm ON mm.src = t.a AND mm.node = t.b JOIN sz x ON x.event = ev.event AND x.src = t.a JOIN sz y ON y.event = ev.event AND y.src = t.b WHERE mm.best >= ev.alpha)
 SELECT event, place, a, b, size_a, size_b FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY least(size_a, size_b) DESC, a, b) AS place FROM j) WHERE place <= 20""",
}
