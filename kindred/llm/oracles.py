"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
    for k in range(8) for s in (15, 10, 5, 0))

OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM p
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s
           AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT x, x AS y FROM (SELECT DISTINCT x FROM links)
          UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""

OP9 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '17', doc_id, size)), 1, 15))::BIGINT AS h FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CAST([3.0, 1.0, 2.0] AS DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget FROM s),
l AS (
  SELECT *, row_number() OVER up AS place,
         (budget - coalesce(sum(cap) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW up AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size, floor(budget)::BIGINT AS budget,
         least(cap, weight * coalesce((SELECT arg_min(level, place) FROM l WHERE level <= cap / weight),
                                      cap / weight)) AS target FROM l),
p AS (
  SELECT h.doc_id, h.size, h.h, t.*,
         sum(size) OVER (PARTITION BY h.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, start + copy * source_size AS begin,
         greatest(0, least(size, round(target)::BIGINT - (start + copy * source_size)))::BIGINT AS words
  FROM p CROSS JOIN (VALUES (0), (1)) k(copy)),
o AS (
  SELECT *, (begin + words) / target AS fin,
         sum(words) OVER (ORDER BY (begin + words) / target, h, doc_id, copy ROWS UNBOUNDED PRECEDING) - words
         AS mix_start FROM c WHERE words > 0),
g AS (
  SELECT doc_id, start, source, sum(greatest(0, least(words, budget - mix_start)))::BIGINT AS taken,
         min(fin) FILTER (WHERE budget > mix_start) AS finish,
         min(mix_start) FILTER (WHERE budget > mix_start) AS mix_start
  FROM o GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(taken, 0)::BIGINT AS taken, finish,
       mix_start::BIGINT AS mix_start
FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.start = g.start AND p.source IS NOT DISTINCT FROM g.source
  AND p.size > 0
"""

OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p
  FROM ws, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
parts AS (
  SELECT lang, k, p, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM (SELECT *, string_split(p, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1 AND a >= 10)),
cuts AS (
  SELECT c.lang, c.k, c.p, c.a, c.j, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.p = c.head AND x.k = c.j
               JOIN f y ON y.lang = c.lang AND y.p = c.tail AND y.k = c.k - c.j),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
covers AS (SELECT lang, a, unnest([regexp_extract(p, '^(.*) [^ ]*$', 1), regexp_extract(p, '^[^ ]* (.*)$', 1)]) AS p
           FROM best WHERE k = 3),
longest AS (SELECT lang, p, max(a) AS over FROM covers GROUP BY lang, p),
kept AS (SELECT b.* FROM best b LEFT JOIN longest o USING (lang, p)
         WHERE b.k = 3 OR over IS NULL OR 100 * over < 50 * b.a)
SELECT lang, rank::INT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank
      FROM kept JOIN totals USING (lang)) WHERE rank <= 2000
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             list_inner_product(a.q, c.q)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES = {
    "op3_content_sort": OP3,
    "op4_warc_transactions": OP4,
    "op6_jaccard_regions": OP6,
    "op9_one_bit_codes": OP9,
    "op10_fair_queueing": OP10,
    "op12_phrase_streams": OP12,
    "op13_residue_negatives": OP13,
}
