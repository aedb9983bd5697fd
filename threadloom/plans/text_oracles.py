"""DuckDB counterparts of the text queries."""

from __future__ import annotations

from threadloom.functions.words import LETTER, LETTER_OR_DIGIT, STOPWORDS, TITLE_FUNCTION_WORDS, word_pattern
from threadloom.plans import graph_oracles
from threadloom.plans.text_queries import FAR, HEADINGS, NEEDLE


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(column: str, unit: str = LETTER) -> str:
    return f"list_transform(regexp_extract_all({column}, {_q(word_pattern(unit))}), lambda w: replace(lower(w), '’', ''''))"


def _paras(name: str = "para", unit: str = LETTER, where: str = "true") -> str:
    return f"""{name}_s AS (SELECT doc_id AS id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: {_tokens("p", unit)}), lambda t: len(t) > 0) AS ps FROM documents),
{name} AS (SELECT * FROM (SELECT id, unnest(range(len(ps))) AS para, unnest(ps) AS toks FROM {name}_s) WHERE {where})"""


def _grams(n: int, para: str = "para", name: str = "gram") -> str:
    return f"""{name} AS (SELECT id, para, pos, array_to_string(toks[pos + 1 : pos + {n}], ' ') AS g FROM (SELECT id, para, toks, unnest(range(len(toks) - {n - 1})) AS pos FROM {para} WHERE len(toks) >= {n}))"""


def _runs(para: str = "para", name: str = "runs") -> str:
    g = f"{name}_g"
    return f"""{_grams(8, para, g)}, {name}_c AS (SELECT g FROM {g} GROUP BY 1 HAVING count(DISTINCT id) > 1), {name}_k AS (SELECT {g}.* FROM {g} JOIN {name}_c USING (g)),
{name}_m AS (SELECT x.id AS a, y.id AS b, x.para AS pa, y.para AS pb, x.pos AS ia, y.pos AS ib FROM {name}_k x JOIN {name}_k y ON x.g = y.g AND x.id < y.id),
{name}_i AS (SELECT *, ia - row_number() OVER (PARTITION BY a, pa, b, pb, ia - ib ORDER BY ia) AS isle FROM {name}_m),
{name}_r AS (SELECT a, pa, b, pb, count(*) + 7 AS length, min(ia) AS ia, min(ib) AS ib FROM {name}_i GROUP BY a, pa, b, pb, ia - ib, isle),
{name} AS (SELECT a, b, length, pa AS para_a, ia AS pos_a, pb AS para_b, ib AS pos_b FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY length DESC, pa, ia, pb, ib) AS rn FROM {name}_r) WHERE rn = 1)"""


WORDS = f"WITH words AS (SELECT doc_id AS id, unnest({_tokens('text')}) AS raw FROM documents), n AS (SELECT count(*) AS n FROM documents)"
COUNTS = WORDS + ", counts AS (SELECT id, regexp_replace(raw, '''s$', '') AS word, count(*) AS tf FROM words GROUP BY 1, 2)"


def _tfidf(counts: str = "counts", tag: str = "") -> str:
    return f"""df{tag} AS (SELECT word, ln((SELECT n FROM n) / count(*)::DOUBLE) AS idf FROM {counts} GROUP BY 1), raw{tag} AS (SELECT id, word, tf * idf AS w FROM {counts} JOIN df{tag} USING (word) WHERE idf > 0),
norm{tag} AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw{tag} GROUP BY 1), vec{tag} AS (SELECT id, word, w / norm AS w FROM raw{tag} JOIN norm{tag} USING (id)),
sc{tag} AS (SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 9) AS score FROM vec{tag} x JOIN vec{tag} y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2),
{_nearest(f"sc{tag}", "SELECT doc_id AS id FROM documents", tag)}"""


def _nearest(scores: str, ids: str, tag: str = "") -> str:
    return f"""ids{tag} AS ({ids}), mirror{tag} AS (SELECT a AS id, b AS nb, score FROM {scores} WHERE score > 0 UNION ALL SELECT b, a, score FROM {scores} WHERE score > 0),
best{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, nb) AS rn FROM mirror{tag}) WHERE rn = 1),
near{tag} AS (SELECT i.id, coalesce(nb, (SELECT min(id) FROM ids{tag} o WHERE o.id <> i.id)) AS neighbor, coalesce(score, 0.0) AS score FROM ids{tag} i LEFT JOIN best{tag} USING (id))"""


_SUPP = (
    graph_oracles.PLAC
    + """, walk AS (SELECT s_suppkey AS src, s_suppkey AS node, 0 AS dist FROM supplier UNION SELECT w.src, n.nbr, w.dist + 1 FROM walk w JOIN adj n ON n.id = w.node WHERE w.dist < 12),
dists AS (SELECT src, node, min(dist) AS dist FROM walk WHERE node IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2),"""
)
_JOINED = (
    _SUPP
    + f""" words AS (SELECT l_suppkey AS id, unnest({_tokens("p_name")}) AS word FROM lineitem JOIN part ON l_partkey = p_partkey), counts AS (SELECT id, word, count(*) AS tf FROM words GROUP BY 1, 2),
nm AS (SELECT id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM counts GROUP BY 1), vec AS (SELECT id, word, tf / norm AS w FROM counts JOIN nm USING (id)),
sc AS (SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 9) AS score FROM vec x JOIN vec y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2),
allp AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey),
rk AS (SELECT a, b, coalesce(score, 0.0) AS score, dist, row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, a, b) AS place FROM allp LEFT JOIN sc USING (a, b) LEFT JOIN dists ON src = a AND node = b)"""
)
_LIST = ", ".join(_q(w) for w in STOPWORDS)
_HEADS = "[" + ", ".join(_q(h) for h in HEADINGS) + "]"

ORACLES = {
    "token_stats": WORDS
    + """, sz AS (SELECT doc_id AS id, coalesce(c, 0) AS n FROM documents LEFT JOIN (SELECT id, count(*) AS c FROM words GROUP BY 1) w ON w.id = doc_id)
 SELECT count(*) AS documents, sum(sz.n)::BIGINT AS tokens, (SELECT count(DISTINCT raw) FROM words) AS types, arg_min(id, (sz.n, id)) AS smallest_id, min(sz.n) AS smallest, arg_min(id, (-sz.n, id)) AS largest_id, max(sz.n) AS largest FROM sz""",
    "paragraph_stats": f"WITH {_paras()} SELECT id, count(*) AS paragraphs, sum(len(toks))::BIGINT AS words, max(len(toks)) AS longest FROM para GROUP BY 1",
    "possessive_terms": f"""WITH w AS (SELECT p_partkey AS id, regexp_replace(unnest({_tokens("p_name || '’s ' || p_type || '''s ' || p_brand")}), '''s$', '') AS word FROM part)
 SELECT word, count(*) AS uses, count(DISTINCT id) AS parts FROM w GROUP BY 1""",
    "ngram_df": f"WITH {_paras()}, {_grams(8)} SELECT g AS gram, documents, documents * (documents - 1) // 2 AS pairs FROM (SELECT g, count(DISTINCT id) AS documents FROM gram GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)",
    "phrase_presence": f"""WITH {_paras()}, {_grams(4)}, top AS (SELECT g, count(DISTINCT id) AS c FROM gram GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
 SELECT g AS gram, count(DISTINCT id) FILTER (para = 0) AS lead_docs, count(DISTINCT id) FILTER (para > 0) AS body_docs FROM gram JOIN top USING (g) GROUP BY 1""",
    "shared_runs": f"WITH {_paras()}, {_runs()} SELECT * FROM runs",
    "run_threshold_curve": f"""WITH {_paras()}, {_runs()}, lev AS (SELECT unnest(range(8, 61)) AS least), n AS (SELECT count(*) AS n FROM documents),
 p AS (SELECT least, count(*) AS pairs FROM lev JOIN runs ON length >= least GROUP BY 1), e AS (SELECT least, count(DISTINCT id) AS documents FROM (SELECT least, unnest([a, b]) AS id FROM lev JOIN runs ON length >= least) GROUP BY 1)
 SELECT least, coalesce(pairs, 0) AS pairs, coalesce(documents, 0) AS documents, round(coalesce(200 * pairs / nullif(n * (n - 1), 0)::DOUBLE, 0), 9) AS percent FROM lev LEFT JOIN p USING (least) LEFT JOIN e USING (least), n""",
    "run_sensitivity": f"""WITH {_paras()}, {_paras("body", where="para > 0")}, {_paras("num", LETTER_OR_DIGIT)}, {_runs("para", "r1")}, {_runs("body", "r2")}, {_runs("num", "r3")}
 SELECT variant, count(*) FILTER (length >= 8) AS pairs_8, count(*) FILTER (length >= 20) AS pairs_20 FROM (SELECT 'plain' AS variant, length FROM r1 UNION ALL SELECT 'without_lead', length FROM r2 UNION ALL SELECT 'with_numerals', length FROM r3) GROUP BY 1""",
    "section_labels": f"""WITH l AS (SELECT id, para, body FROM (SELECT doc_id AS id, unnest(range(len(ps))) AS para, unnest(ps) AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents))),
 h AS (SELECT id, para, CASE WHEN list_contains({_HEADS}, trim(body)) THEN trim(body) END AS heading FROM l),
 x AS (SELECT id, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Lead') AS section FROM h) SELECT id, section, count(*) AS paragraphs FROM x GROUP BY 1, 2""",
    "bag_cosine_top": WORDS
    + f""", c AS (SELECT id, raw AS word, count(*) AS tf FROM words WHERE raw NOT IN ({_LIST}) GROUP BY 1, 2), nm AS (SELECT id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM c GROUP BY 1), v AS (SELECT id, word, tf / norm AS w FROM c JOIN nm USING (id))
 SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS score FROM v x JOIN v y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5""",
    "spearman_length_degree": """WITH d AS (SELECT length(text) AS x, len(string_split(text, chr(10))) AS y FROM documents),
 r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d) SELECT round(corr(rx, ry), 9) AS spearman FROM r""",
    "tfidf_weights": COUNTS + f", {_tfidf()} SELECT id, count(*) AS terms, round(sum(w), 9) AS mass, round(max(w), 9) AS largest FROM vec GROUP BY 1",
    "tfidf_nearest": COUNTS + f", {_tfidf()} SELECT id, neighbor, score FROM near",
    "top_terms": COUNTS
    + f""", {_tfidf()}, pr AS (SELECT near.id, neighbor, x.word, round(x.w * y.w, 9) AS product FROM near JOIN vec x ON x.id = near.id JOIN vec y ON y.id = neighbor AND y.word = x.word),
 rk AS (SELECT *, sum(product) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY product DESC, word) AS place FROM pr)
 SELECT id, neighbor, place, word, product, round(product / nullif(total, 0), 6) AS share FROM rk WHERE place <= 3""",
    "title_mask": f"""WITH w AS (SELECT row_number() OVER () AS r, regexp_replace(unnest({_tokens("p_name")}), '''s$', '') AS word FROM part), u AS (SELECT DISTINCT p_partkey, regexp_replace(x, '''s$', '') AS word FROM (SELECT p_partkey, unnest({_tokens("p_name")}) AS x FROM part))
 SELECT word, count(*) AS titles FROM u WHERE length(word) >= 2 AND word NOT IN ({", ".join(_q(w) for w in TITLE_FUNCTION_WORDS)}) GROUP BY 1""",
    "ablation_report": COUNTS
    + f""", {_tfidf()}, mask AS (SELECT word FROM counts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50), kept AS (SELECT * FROM counts WHERE word NOT IN (SELECT word FROM mask)), {_tfidf("kept", "2")},
 sz AS (SELECT id, sum(tf)::BIGINT AS a, coalesce(sum(tf) FILTER (word IN (SELECT word FROM mask)), 0)::BIGINT AS r FROM counts GROUP BY 1)
 SELECT x.id, x.neighbor AS before, x.score AS before_score, y.neighbor AS after, y.score AS after_score, x.neighbor <> y.neighbor AS changed, coalesce(s.score, 0.0) AS same_pair_after, coalesce(r, 0) AS removed, round(coalesce(r / sz.a::DOUBLE, 0), 9) AS removed_share
 FROM near x JOIN near2 y USING (id) LEFT JOIN sc2 s ON s.a = least(x.id, x.neighbor) AND s.b = greatest(x.id, x.neighbor) LEFT JOIN sz ON sz.id = x.id""",
    "ablation_summary": COUNTS
    + f""", {_tfidf()}, mask AS (SELECT word FROM counts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50), kept AS (SELECT * FROM counts WHERE word NOT IN (SELECT word FROM mask)), {_tfidf("kept", "2")}
 SELECT count(*) FILTER (x.neighbor <> y.neighbor) AS changed, count(*) FILTER (x.neighbor = y.neighbor) AS unchanged, (SELECT sum(tf)::BIGINT FROM counts WHERE word IN (SELECT word FROM mask)) AS removed,
 round(median(x.score), 9) AS median_before, round(median(coalesce(s.score, 0.0)), 9) AS median_after FROM near x JOIN near2 y USING (id) LEFT JOIN sc2 s ON s.a = least(x.id, x.neighbor) AND s.b = greatest(x.id, x.neighbor)""",
    "word_spans": f"""WITH w AS (SELECT doc_id AS id, text, regexp_extract_all(text, {_q(word_pattern(LETTER))}) AS ws FROM documents)
 SELECT id, len(ws) AS words, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_matches(p, '\\p{{L}}'))) - 1 AS last_para, length(regexp_replace(text, '\\P{{L}}+$', '')) AS last_end, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS letters FROM w WHERE len(ws) > 0""",
    "term_excerpt": COUNTS
    + f""", {_tfidf()}, w9 AS (SELECT id, word, round(w, 9) AS w FROM vec), f AS (SELECT id, arg_min(word, (-w, word)) AS term FROM w9 GROUP BY 1),
 x AS (SELECT f.id, term, text, regexp_extract_all(text, {_q(word_pattern(LETTER))}) AS ws, string_split_regex(text, {_q(word_pattern(LETTER))}) AS gs FROM f JOIN documents ON doc_id = f.id),
 k AS (SELECT *, list_position(list_transform(ws, lambda w: regexp_replace(replace(lower(w), '’', ''''), '''s$', '')), term) AS k FROM x),
 h AS (SELECT id, term, text, ws[k] AS hit, (list_sum(list_transform(gs[1 : k], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1 : k - 1], lambda g: length(g))), 0))::BIGINT AS ahead FROM k),
 p AS (SELECT *, regexp_replace(left(text, ahead), '^(?s:.*)\\n\\n', '') AS ld, string_split(substring(text, ahead + length(hit) + 1), chr(10) || chr(10))[1] AS tr FROM h),
 r AS (SELECT *, length(ld) + length(hit) + length(tr) > 360 AS big, right(ld, 180) AS nl, left(tr, greatest(0, 360 - least(length(ld), 180) - length(hit))) AS nt FROM p),
 c AS (SELECT *, CASE WHEN big AND length(ld) > 180 THEN substring(nl, instr(nl, ' ') + 1) ELSE ld END AS l, CASE WHEN big AND length(tr) > length(nt) THEN regexp_replace(nt, ' [^ ]*$', '') ELSE tr END AS t FROM r),
 e AS (SELECT id, term, text, ahead - length(l) AS start, l || hit || t AS excerpt FROM c)
 SELECT id, term, start, start + length(excerpt) AS "end", excerpt, substring(text, greatest(0, start - 80) + 1, start - greatest(0, start - 80)) AS before, substring(text, start + length(excerpt) + 1, 80) AS after FROM e""",
    "literal_excerpt": f"""WITH f AS (SELECT doc_id AS id, text, instr(text, {_q(NEEDLE)}) AS p FROM documents WHERE instr(text, {_q(NEEDLE)}) > 0)
 SELECT id, p - 1 AS start, p - 1 + {len(NEEDLE)} AS "end", substring(text, greatest(1, p - 60), p - greatest(1, p - 60)) AS before, substring(text, p + {len(NEEDLE)}, 60) AS after FROM f""",
    "tfidf_terms": COUNTS + f", {_tfidf()}, w9 AS (SELECT id, word, round(w, 9) AS w FROM vec) SELECT id, arg_min(word, (-w, word)) AS term FROM w9 GROUP BY 1",
    "pair_category": f"WITH {_paras()}, {_runs()} SELECT a, b, length, CASE WHEN para_a = 0 AND para_b = 0 THEN 'lead' WHEN length >= 20 THEN 'copied' ELSE 'formula' END AS category FROM runs",
    "pair_rank": COUNTS + f", {_tfidf()} SELECT x.id AS a, y.id AS b, coalesce(score, 0.0) AS score, row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, x.id, y.id) AS place FROM ids x JOIN ids y ON x.id < y.id LEFT JOIN sc ON a = x.id AND b = y.id",
    "lexical_vs_distance": _JOINED
    + f""", {_nearest("sc", "SELECT s_suppkey AS id FROM supplier")}, alln AS (SELECT (count(*) * (count(*) - 1) // 2)::BIGINT AS n FROM supplier), bk AS (SELECT unnest(['1', '2', '3', '4+', 'disconnected']) AS bucket),
 c AS (SELECT CASE WHEN dist >= 4 THEN '4+' ELSE dist::VARCHAR END AS bucket, count(*) AS pairs FROM dists WHERE src < node GROUP BY 1 UNION ALL SELECT 'disconnected', (SELECT n FROM alln) - (SELECT count(*) FROM dists WHERE src < node)),
 m AS (SELECT CASE WHEN dist IS NULL THEN 'disconnected' WHEN dist >= 4 THEN '4+' ELSE dist::VARCHAR END AS bucket, count(*) AS nearest FROM near LEFT JOIN dists ON src = id AND node = neighbor WHERE neighbor IS NOT NULL GROUP BY 1)
 SELECT bucket, coalesce(nearest, 0) AS nearest, round(coalesce(nearest / nullif((SELECT count(neighbor) FROM near), 0)::DOUBLE, 0), 9) AS nearest_share, 2 * coalesce(pairs, 0) AS all_pairs, round(coalesce(pairs, 0) / nullif((SELECT n FROM alln), 0)::DOUBLE, 9) AS all_share
 FROM bk LEFT JOIN c USING (bucket) LEFT JOIN m USING (bucket)""",
    "far_pairs": _JOINED + f" SELECT a, b, score, dist::BIGINT AS dist, place FROM rk WHERE dist >= {FAR} ORDER BY place LIMIT 20",
    "disconnected_pair": _JOINED + " SELECT a, b, score, place FROM rk WHERE dist IS NULL ORDER BY place LIMIT 1",
}
