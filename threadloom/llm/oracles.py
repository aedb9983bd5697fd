"""DuckDB SQL of the divergence, search and mixing queries."""

#: Terms by language and source, shares in 128-bit integers, all pairs of sources over all kept terms.
DIVERGENCE = r"""WITH t AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT row, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM t),
 k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
 l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY 1),
 g AS (SELECT DISTINCT lang, source FROM t),
 c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 gt AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
 p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * l.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v))::BIGINT AS q
  FROM gt JOIN k ON k.lang = gt.lang JOIN l ON l.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
 f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p))::BIGINT AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3),
 r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""

#: Every document scored for every item that shares a term with it.
SEARCH = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
 low AS (SELECT row, doc_id, len(ts) AS n, unnest(list_transform(ts, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d WHERE len(ts) > 0),
 st AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
 tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM low GROUP BY 1, 2, 3, 4),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY term, docs),
 q AS (SELECT item, item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark))),
 s AS (SELECT item, item_id, row, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term), st GROUP BY 1, 2, 3, 4)
 SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

#: Targets by the prefix of capped sources in the order of words per weight, then prefix sums in the order of the keys.
MIXING = r"""WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat('0-', coalesce(doc_id::VARCHAR, ''), '-', md5(coalesce(text, '')))) AS h FROM documents),
 q AS (SELECT doc_id, 0.5 + 1.5 * avg(quality) AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
 k AS (SELECT r.doc_id, source, size, -ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key, ('0x' || substr(h, 14, 15))::BIGINT AS tie FROM r LEFT JOIN q ON q.doc_id = r.doc_id),
 s AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM r GROUP BY 1),
 sw AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INTEGER] AS w FROM s),
 f AS (SELECT *, row_number() OVER o AS n, (1.5::DOUBLE * sum(words) OVER () - 2 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM sw WINDOW o AS (ORDER BY words / w, place)),
 l AS (SELECT arg_min(level, n) AS level FROM f WHERE 2 * words >= level * w),
 t AS (SELECT source, words, least((2 * words)::DOUBLE, level * w)::DOUBLE AS target FROM sw, l),
 e AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS epochs FROM t),
 c AS (SELECT doc_id, size, words, target, epochs, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, tie, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k JOIN e ON e.source IS NOT DISTINCT FROM k.source)
 SELECT doc_id, size, words AS source_size, target, (size * (epochs + CASE WHEN ahead + size / 2.0 <= target - epochs * words THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""
