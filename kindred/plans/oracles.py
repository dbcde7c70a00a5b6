"""DuckDB SQL for each registered query (same column names, same rounding).

Views ``documents labels events embeddings conversations pages part ...`` are
registered by the caller. Shared steps are CTE fragments below.
"""

from __future__ import annotations

WORDS = r"""words AS (
  SELECT doc_id AS unit_id,
         unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token
  FROM documents)"""

FREQ = r"""freq AS (
  SELECT token AS name, count(*)::BIGINT AS frequency
  FROM words WHERE length(token) >= 3 GROUP BY token)"""

VOCAB = r"""vocab AS (
  SELECT name, frequency, idx FROM (
    SELECT name, frequency,
           (row_number() OVER (ORDER BY frequency DESC, name DESC) - 1)::INTEGER AS idx
    FROM freq
    WHERE regexp_matches(name, '^[a-zA-Z_]+\p{Nd}*$') AND frequency >= 20) v
  WHERE idx < 2000)"""

COUNTS = r"""counts AS (
  SELECT w.unit_id, v.idx, count(*)::BIGINT AS cnt
  FROM words w JOIN vocab v ON w.token = v.name GROUP BY 1, 2)"""

WEIGHTS = r"""dfs AS (SELECT idx, count(*)::BIGINT AS df FROM counts GROUP BY idx),
nn AS (SELECT count(DISTINCT unit_id) AS n FROM counts),
raw AS (
  SELECT c.unit_id, c.idx,
         c.cnt::DOUBLE / sum(c.cnt) OVER (PARTITION BY c.unit_id)
           * (1 + ln((nn.n + 1.0) / (dfs.df + 1.0))) AS w
  FROM counts c JOIN dfs USING (idx), nn),
weights AS (
  SELECT unit_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY unit_id)) AS w FROM raw)"""

COS_PAIRS = r"""dots AS (
  SELECT a.unit_id AS i, b.unit_id AS j, sum(a.w * b.w) AS s
  FROM weights a JOIN weights b ON a.idx = b.idx AND a.unit_id < b.unit_id
  GROUP BY 1, 2),
pairs AS (SELECT i, j, 1 - s AS dist FROM dots WHERE 1 - s < 0.4)"""

JAC_PAIRS = r"""sz AS (SELECT unit_id, count(*) AS n FROM counts GROUP BY 1),
inter AS (
  SELECT a.unit_id AS i, b.unit_id AS j, count(*) AS k
  FROM counts a JOIN counts b ON a.idx = b.idx AND a.unit_id < b.unit_id GROUP BY 1, 2),
jpairs AS (
  SELECT i, j, k, si.n AS ni, sj.n AS nj, 1 - k::DOUBLE / (si.n + sj.n - k) AS dist
  FROM inter JOIN sz si ON si.unit_id = i JOIN sz sj ON sj.unit_id = j
  WHERE 1 - k::DOUBLE / (si.n + sj.n - k) < 0.5)"""

COMPONENTS = r"""edges AS (SELECT i AS a, j AS b FROM pairs UNION ALL SELECT j, i FROM pairs),
nodes AS (SELECT DISTINCT unit_id FROM counts),
reach(node, root) AS (
  SELECT unit_id, unit_id FROM nodes
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a),
comp AS (SELECT node AS unit_id, min(root) AS component FROM reach GROUP BY node)"""

NA_LIST = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
           "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")

CONV = f"""WITH conv AS (
  SELECT conv_id AS file, turn AS pos, text AS token, turn AS line, role FROM conversations
  WHERE text IS NOT NULL AND text NOT IN ({NA_LIST}))"""

REASON = """CASE WHEN count(*) = 0 THEN 'no functions found!'
  WHEN count_if(role = 'user') <> count_if(role = 'assistant') THEN 'has different number of start and end in parsed!!!'
  WHEN count_if(role = 'user') = 0 THEN 'no functions found!'
  WHEN count(line) = 0 THEN 'no tokenized found!' END"""

CONV_UNITS = """ok AS (SELECT file FROM conv GROUP BY file
  HAVING count_if(role = 'user') = count_if(role = 'assistant') AND count_if(role = 'user') > 0 AND count(line) > 0),
bs AS (SELECT file, pos AS begin_pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM conv WHERE role = 'user'),
es AS (SELECT file, pos AS end_pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM conv WHERE role = 'assistant'),
units AS (SELECT bs.file, bs.k::INTEGER AS k, begin_pos, end_pos FROM bs JOIN es USING (file, k) WHERE file IN (SELECT file FROM ok))
"""

CONV_LINES = """lastl AS (SELECT file, arg_max(line, pos) FILTER (WHERE line IS NOT NULL) AS last_line FROM conv GROUP BY file),
ulines AS (SELECT u.file, u.k, s.line AS start_line, coalesce(e.line, l.last_line) AS end_line,
  CASE WHEN s.line IS NULL THEN 'no start line' END AS reason
  FROM units u LEFT JOIN conv s ON s.file = u.file AND s.pos = u.begin_pos + 1
  LEFT JOIN conv e ON e.file = u.file AND e.pos = u.end_pos + 2
  LEFT JOIN lastl l ON l.file = u.file)
"""

PAGES = r"""WITH pieces AS (
  SELECT page_id AS file, unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) AS token,
         unnest(range(len(regexp_extract_all(html, '<[^>]*>|[^<]+'))))::BIGINT AS pos FROM pages),
ptok AS (SELECT file, pos, token,
  coalesce(sum(length(token) - length(replace(token, chr(10), ''))) OVER (PARTITION BY file ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line,
  regexp_matches(token, '^<p[\s>]') AS is_b, token = '</p>' AS is_e FROM pieces)"""

REASON_P = """CASE WHEN count(*) = 0 THEN 'no functions found!'
  WHEN count_if(is_b) <> count_if(is_e) THEN 'has different number of start and end in parsed!!!'
  WHEN count_if(is_b) = 0 THEN 'no functions found!'
  WHEN count(line) = 0 THEN 'no tokenized found!' END"""

PAGE_UNITS = """ok AS (SELECT file FROM ptok GROUP BY file
  HAVING count_if(is_b) = count_if(is_e) AND count_if(is_b) > 0 AND count(line) > 0),
bs AS (SELECT file, pos AS begin_pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM ptok WHERE is_b),
es AS (SELECT file, pos AS end_pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM ptok WHERE is_e),
units AS (SELECT bs.file, bs.k::INTEGER AS k, begin_pos, end_pos FROM bs JOIN es USING (file, k) WHERE file IN (SELECT file FROM ok))
"""

EVENTS = r"""WITH etok AS (
  SELECT user_id AS file, event_id AS pos,
    CASE event_type WHEN 'signup' THEN 'BEGIN_METHOD' WHEN 'purchase' THEN 'END_METHOD'
      WHEN 'view' THEN 'BEGIN_BLOCK' WHEN 'click' THEN 'END_BLOCK' ELSE event_type END AS token,
    CASE WHEN event_type IN ('signup', 'purchase', 'view', 'click') THEN NULL ELSE value END AS line,
    CAST(nullif(regexp_extract(props, '(\d+)', 1), '') AS INTEGER) AS kind,
    minute(ts)::INTEGER AS col FROM events)"""

TAGS = """WITH rep AS (
  SELECT doc_id AS unit_id, 'Toxic' AS name FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'Low_Quality' FROM labels WHERE quality = 0
  UNION ALL SELECT doc_id, 'Reviewed' FROM labels),
tags AS (SELECT unit_id, string_agg(DISTINCT lower(name), ',' ORDER BY lower(name)) AS tags FROM rep GROUP BY unit_id)
"""

EMB = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)
"""

KNN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label,
    substr(md5(vec_id::VARCHAR || ':7'), 1, 8) < '40000000' AS is_test FROM embeddings),
te AS (SELECT * FROM e WHERE is_test), tr AS (SELECT * FROM e WHERE NOT is_test),
d AS (SELECT te.vec_id AS i, tr.vec_id AS j, tr.label AS lj, list_distance(te.v, tr.v) AS dist FROM te, tr),
top AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) <= 5),
votes AS (SELECT i, lj, count(*) AS c FROM top GROUP BY 1, 2),
win AS (SELECT i, lj AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, lj ASC) = 1),
pred AS (SELECT te.vec_id, te.label, win.prediction FROM te JOIN win ON win.i = te.vec_id)
"""

CONF = "conf AS (SELECT label, prediction, count(*)::BIGINT AS n FROM pred GROUP BY 1, 2)\n"

REPORT = """tp AS (SELECT label AS class, n AS tp FROM conf WHERE label = prediction),
sup AS (SELECT label AS class, sum(n) AS support FROM conf GROUP BY 1),
pc AS (SELECT prediction AS class, sum(n) AS predicted FROM conf GROUP BY 1),
pr AS (SELECT s.class, s.support::BIGINT AS support,
  CASE WHEN coalesce(p.predicted, 0) > 0 THEN coalesce(t.tp, 0) / p.predicted ELSE 0 END AS precision,
  CASE WHEN s.support > 0 THEN coalesce(t.tp, 0) / s.support ELSE 0 END AS recall
  FROM sup s LEFT JOIN tp t USING (class) LEFT JOIN pc p USING (class)),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)
"""

CLASSES = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, list_sum(embedding::DOUBLE[]) AS rsum FROM embeddings),
q AS (SELECT label, quantile_cont(rsum, 0.5) AS q FROM e GROUP BY label),
cls AS (SELECT e.*, CASE WHEN rsum > q.q THEN 0 ELSE 1 END::INTEGER AS class FROM e JOIN q USING (label))
"""

EUC_CD = """cd AS (SELECT a.label, b.class, avg(list_distance(a.v, b.v)) AS dist
  FROM cls a JOIN cls b ON a.label = b.label GROUP BY a.label, b.class)
"""

SEP = """sep AS (SELECT label, max(CASE WHEN class = 1 THEN dist END) / max(CASE WHEN class = 0 THEN dist END) AS ratio,
  max(CASE WHEN class = 1 THEN dist END) - max(CASE WHEN class = 0 THEN dist END) AS diff,
  (max(CASE WHEN class = 0 THEN dist END) < max(CASE WHEN class = 1 THEN dist END))::INTEGER AS no_lt_yes
  FROM cd GROUP BY label)
"""


def w(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


DOC = (WORDS, FREQ, VOCAB, COUNTS)

ORACLES: dict[str, str] = {
    "token_freq": w(WORDS, FREQ) + "SELECT name, frequency FROM freq",
    "vocab_sorted": w(WORDS, FREQ) + """SELECT name, frequency,
  row_number() OVER (ORDER BY frequency DESC, name DESC)::BIGINT AS rank FROM freq""",
    "vocab_clean": w(WORDS, FREQ) + r"""SELECT name, frequency FROM freq
  WHERE regexp_matches(name, '^[a-zA-Z_]+\p{Nd}*$')""",
    "vocab_cut": w(WORDS, FREQ, VOCAB) + "SELECT name, frequency, idx FROM vocab",
    "topn_vocab": w(WORDS) + """SELECT name, frequency,
  (row_number() OVER (ORDER BY frequency DESC, name ASC) - 1)::INTEGER AS idx
FROM (SELECT token AS name, count(*)::BIGINT AS frequency FROM words GROUP BY 1
      ORDER BY frequency DESC, name ASC LIMIT 200) t""",
    "normalize_text": r"""SELECT doc_id AS unit_id,
  trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N} _\-]', '', 'g'), ' +', ' ', 'g')) AS norm
FROM documents""",
    "short_units": """SELECT doc_id AS unit_id, n_lines FROM (
  SELECT doc_id, greatest(len(string_split(text, chr(10))), 1)::BIGINT AS n_lines FROM documents) t
WHERE n_lines >= 5""",
    "vocab_semi": w(*DOC) + "SELECT DISTINCT unit_id FROM counts",
    "term_counts": w(*DOC) + "SELECT unit_id, idx, cnt FROM counts",
    "binary_terms": w(*DOC) + "SELECT unit_id, idx, 1::BIGINT AS cnt FROM counts",
    "term_totals": w(*DOC) + "SELECT idx, sum(cnt)::BIGINT AS total FROM counts GROUP BY idx",
    "doc_freq": w(*DOC) + "SELECT idx, count(*)::BIGINT AS df FROM counts GROUP BY idx",
    "unit_count": w(*DOC) + "SELECT count(DISTINCT unit_id)::BIGINT AS n_units FROM counts",
    "ngram_counts": r"""WITH ws AS (
  SELECT doc_id AS unit_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
grams AS (
  SELECT unit_id, unnest(w) AS gram FROM ws
  UNION ALL
  SELECT unit_id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM ws)
SELECT unit_id, gram, count(*)::BIGINT AS cnt FROM grams GROUP BY 1, 2""",
    "tfidf_weights": w(*DOC, WEIGHTS) + "SELECT unit_id, idx, round(w, 6) AS w FROM weights",
    "row_norms": w(*DOC, WEIGHTS) + """SELECT unit_id, round(sum(w), 6) AS l1,
  round(sqrt(sum(w * w)), 6) AS l2 FROM weights GROUP BY unit_id""",
    "pair_distance_cosine": w(*DOC, WEIGHTS, COS_PAIRS) + "SELECT i, j, round(dist, 6) AS dist FROM pairs",
    "pair_distance_jaccard": w(*DOC, JAC_PAIRS) + "SELECT i, j, round(dist, 6) AS dist FROM jpairs",
    "binary_cells": w(*DOC, JAC_PAIRS) + """SELECT i, j, k::BIGINT AS n11, (ni - k)::BIGINT AS n10,
  (nj - k)::BIGINT AS n01, ((SELECT count(*) FROM vocab) - ni - nj + k)::BIGINT AS n00 FROM jpairs""",
    "square_form": w(*DOC, WEIGHTS, COS_PAIRS) + """SELECT i, j, round(dist, 6) AS dist FROM pairs
UNION ALL SELECT j, i, round(dist, 6) FROM pairs
UNION ALL SELECT DISTINCT unit_id, unit_id, 0.0::DOUBLE FROM counts""",
    "clusters_single": w(*DOC, WEIGHTS, COS_PAIRS, COMPONENTS, recursive=True)
    + "SELECT unit_id, component FROM comp",
    "cluster_sizes": w(*DOC, WEIGHTS, COS_PAIRS, COMPONENTS, recursive=True)
    + "SELECT component AS cluster_id, count(*)::BIGINT AS size FROM comp GROUP BY 1",
    "cluster_report": w(*DOC, WEIGHTS, COS_PAIRS, COMPONENTS, recursive=True) + """,
sizes AS (SELECT component FROM comp GROUP BY component HAVING count(*) > 15)
SELECT c.component AS cluster_id, count(*)::BIGINT AS size, count(l.toxic)::BIGINT AS n_labelled,
  coalesce(sum(l.toxic), 0)::BIGINT AS n_toxic, round(avg(l.toxic), 6) AS toxic_rate,
  round(avg(l.quality), 6) AS quality_rate
FROM comp c JOIN sizes s USING (component) LEFT JOIN labels l ON l.doc_id = c.unit_id
GROUP BY c.component""",
    "marker_check": CONV + """SELECT file, count(*)::BIGINT AS n_rows,
  count_if(role = 'user')::BIGINT AS n_begin, count_if(role = 'assistant')::BIGINT AS n_end,
  count(line)::BIGINT AS n_line, """ + REASON + """ AS reason FROM conv GROUP BY file""",
    "marker_errors": PAGES + """SELECT file, reason FROM (SELECT file, """ + REASON_P + """ AS reason
  FROM ptok GROUP BY file) t WHERE reason IS NOT NULL""",
    "pair_units": CONV + ",\n" + CONV_UNITS + "SELECT file, k, begin_pos, end_pos FROM units",
    "page_units": PAGES + ",\n" + PAGE_UNITS + "SELECT file, k, begin_pos, end_pos FROM units",
    "unit_text": CONV + ",\n" + CONV_UNITS + r"""SELECT u.file, u.k, u.begin_pos, u.end_pos,
  coalesce(trim(regexp_replace(regexp_replace(lower(string_agg(c.token, ' ' ORDER BY c.pos)),
    '[^\p{L}\p{N} _\-]', '', 'g'), ' +', ' ', 'g')), '') AS text
FROM units u LEFT JOIN conv c ON c.file = u.file AND c.pos BETWEEN u.begin_pos AND u.end_pos
GROUP BY u.file, u.k, u.begin_pos, u.end_pos""",
    "unit_lines": CONV + ",\n" + CONV_UNITS + ",\n" + CONV_LINES
    + "SELECT file, k, start_line, end_line, reason FROM ulines",
    "unit_raw": CONV + ",\n" + CONV_UNITS + ",\n" + CONV_LINES + """
SELECT u.file, u.k, coalesce((SELECT string_agg(c.token, chr(10) ORDER BY c.pos) FROM (
    SELECT token, pos, row_number() OVER (ORDER BY pos) - 1 AS ln FROM conv c2 WHERE c2.file = u.file) c
  WHERE c.ln >= u.start_line AND c.ln < u.end_line), '') AS raw
FROM ulines u""",
    "last_line": PAGES + """SELECT file, arg_max(line, pos) FILTER (WHERE line IS NOT NULL) AS last_line
FROM ptok GROUP BY file""",
    "fill_marker_lines": EVENTS + """,
f1 AS (SELECT *, CASE WHEN token IN ('END_METHOD', 'END_BLOCK') AND line IS NULL
    THEN last_value(line IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
    ELSE line END AS line1 FROM etok),
f2 AS (SELECT *, CASE WHEN token IN ('BEGIN_METHOD', 'BEGIN_BLOCK') AND line1 IS NULL
    THEN first_value(line1 IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)
    ELSE line1 END AS line2 FROM f1)
SELECT pos AS event_id, file AS user_id, token, line2 AS line,
  CASE token WHEN 'BEGIN_METHOD' THEN 8001 WHEN 'END_METHOD' THEN 8002 WHEN 'BEGIN_BLOCK' THEN 8003
    WHEN 'END_BLOCK' THEN 8004 ELSE kind END::INTEGER AS kind,
  CASE WHEN token IN ('BEGIN_METHOD', 'END_METHOD', 'BEGIN_BLOCK', 'END_BLOCK') THEN 0 ELSE col END::INTEGER AS col
FROM f2""",
    "islands": """WITH x AS (SELECT user_id, event_id, event_type,
  CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type
    THEN 0 ELSE 1 END AS chg FROM events),
r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, run::BIGINT AS run, first(event_type ORDER BY event_id) AS value, min(event_id) AS start,
  max(event_id) AS "end", count(*)::BIGINT AS length
FROM r GROUP BY user_id, run HAVING count(*) > 1""",
    "tag_units": TAGS + """SELECT d.doc_id AS unit_id, coalesce(t.tags, '') AS tags,
  CASE WHEN t.tags LIKE '%toxic%' THEN 1 ELSE 0 END::INTEGER AS gt
FROM documents d LEFT JOIN tags t ON t.unit_id = d.doc_id""",
    "tag_units_any": TAGS + """SELECT d.doc_id AS unit_id, coalesce(t.tags, '') AS tags,
  CASE WHEN t.tags IS NOT NULL THEN 1 ELSE 0 END::INTEGER AS gt
FROM documents d LEFT JOIN tags t ON t.unit_id = d.doc_id""",
    "findings_by_type": """SELECT event_type AS name, count(*)::BIGINT AS n FROM events GROUP BY 1
UNION ALL SELECT '__total__', count(*)::BIGINT FROM events
UNION ALL SELECT '__keyword__', count_if(event_type LIKE '%XSS%' OR event_type LIKE '%SQL%')::BIGINT FROM events""",
    "pair_distance_dense": EMB + """SELECT a.vec_id AS i, b.vec_id AS j,
  round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS dist
FROM e a JOIN e b ON a.vec_id < b.vec_id
WHERE 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) < 0.75""",
    "pair_distance_euclidean": EMB + """SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.v, b.v), 6) AS dist
FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_distance(a.v, b.v) < 1.2""",
    "user_metric": EMB + """SELECT a.vec_id AS i, b.vec_id AS j,
  round(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: abs(a.v[k] - b.v[k]))), 6) AS dist
FROM e a JOIN e b ON a.vec_id < b.vec_id
WHERE 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) < 0.75""",
    "nearest_unit": EMB + """SELECT i, j, round(dist, 6) AS dist FROM (
  SELECT a.vec_id AS i, b.vec_id AS j,
    1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS dist
  FROM e a JOIN e b ON a.vec_id <> b.vec_id) t
QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) = 1""",
    "knn_vote": KNN + "SELECT vec_id, label, prediction FROM pred",
    "confusion": KNN + ",\n" + CONF + "SELECT label, prediction, n FROM conf",
    "accuracy": KNN + ",\n" + CONF + """SELECT round(sum(CASE WHEN label = prediction THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM conf""",
    "class_report": KNN + ",\n" + CONF + ",\n" + REPORT + """SELECT class, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""",
    "most_confused": KNN + ",\n" + CONF + """,
off AS (SELECT * FROM conf WHERE label <> prediction),
rt AS (SELECT label, sum(n) AS t FROM conf GROUP BY label),
ct AS (SELECT prediction, sum(n) AS t FROM conf GROUP BY prediction),
r AS (SELECT o.label AS class, printf('%s_%.4f', o.prediction::VARCHAR, o.n / rt.t) AS by_recall
  FROM off o JOIN rt USING (label) QUALIFY row_number() OVER (PARTITION BY o.label ORDER BY o.n DESC, o.prediction) = 1),
p AS (SELECT o.prediction AS class, printf('%s_%.4f', o.label::VARCHAR, o.n / ct.t) AS by_precision
  FROM off o JOIN ct USING (prediction) QUALIFY row_number() OVER (PARTITION BY o.prediction ORDER BY o.n DESC, o.label) = 1)
SELECT c.class, r.by_recall, p.by_precision FROM (SELECT DISTINCT label AS class FROM conf) c
LEFT JOIN r USING (class) LEFT JOIN p USING (class)""",
    "log_confusion": KNN + ",\n" + CONF + "SELECT label, prediction, n, round(log10(n + 1), 6) AS log_n FROM conf",
    "misclassified": KNN + "SELECT vec_id, label, prediction FROM pred WHERE label <> prediction",
    "row_mean_std": EMB + """SELECT vec_id, round(list_avg(v), 6) AS mean,
  round(sqrt(greatest(list_sum(list_transform(v, lambda x: x * x)) / len(v) - list_avg(v) * list_avg(v), 0)), 6) AS std FROM e""",
    "centroids": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x,
  unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings)
SELECT label, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY label, dim""",
    "percentile_label": """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.8) FROM lineitem) THEN 0 ELSE 1 END::INTEGER AS class
FROM lineitem""",
    "group_classes": CLASSES + "SELECT vec_id, label, class FROM cls",
    "class_distance": CLASSES + """SELECT a.label, b.class,
  round(avg(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 6) AS dist
FROM cls a JOIN cls b ON a.label = b.label GROUP BY a.label, b.class""",
    "class_distance_euclidean": CLASSES + ",\n" + EUC_CD + "SELECT label, class, round(dist, 6) AS dist FROM cd",
    "class_separation": CLASSES + ",\n" + EUC_CD + ",\n" + SEP + """SELECT label, round(ratio, 6) AS ratio,
  round(diff, 6) AS diff, no_lt_yes FROM sep""",
    "separation_summary": CLASSES + ",\n" + EUC_CD + ",\n" + SEP + """SELECT round(avg(ratio), 6) AS avg_ratio,
  round(avg(diff), 6) AS avg_diff, round(avg(no_lt_yes), 6) AS share_no_lt_yes FROM sep""",
    "kept_clusters": w(*DOC, WEIGHTS, COS_PAIRS, COMPONENTS, recursive=True) + """,
sz AS (SELECT component, count(*)::BIGINT AS cluster_size FROM comp GROUP BY component HAVING count(*) > 15)
SELECT c.unit_id, c.component AS cluster_id, sz.cluster_size,
  (row_number() OVER (PARTITION BY c.component ORDER BY c.unit_id) - 1)::BIGINT AS position
FROM comp c JOIN sz USING (component)""",
    "minmax": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v,
    substr(md5(vec_id::VARCHAR || ':7'), 1, 8) < '40000000' AS is_test FROM embeddings),
x AS (SELECT vec_id, is_test, unnest(v) AS x, unnest(range(len(v)))::INTEGER AS dim FROM e),
mm AS (SELECT dim, min(x) AS mn, max(x) AS mx FROM x WHERE NOT is_test GROUP BY dim)
SELECT vec_id, dim, round(CASE WHEN mx = mn THEN 0.5 ELSE (x - mn) / (mx - mn) END, 6) AS x
FROM x JOIN mm USING (dim) WHERE is_test""",
    "label_index": """SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS type_idx FROM part""",
    "split": """SELECT vec_id, CASE WHEN substr(md5(vec_id::VARCHAR || ':7'), 1, 8) < '40000000' THEN 1 ELSE 0 END::INTEGER AS is_test
FROM embeddings""",
    "sample_k": """SELECT doc_id AS unit_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id LIMIT 100""",
    "sample_replace": """WITH f AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS file_idx FROM documents),
n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT unnest(range(CAST(floor(n * 0.02) AS BIGINT))) AS draw, n FROM n),
d AS (SELECT draw, floor(('0x' || substr(md5(draw::VARCHAR || ':3'), 1, 13))::BIGINT::DOUBLE
    / 4503599627370496.0 * n)::BIGINT AS file_idx FROM r)
SELECT d.draw::BIGINT AS draw, d.file_idx, f.doc_id FROM d JOIN f USING (file_idx)""",
    "word_difference": r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents)
SELECT word FROM w WHERE lang = 'en' EXCEPT SELECT word FROM w WHERE lang = 'fr'""",
    "distinct_words": w(WORDS) + "SELECT DISTINCT token AS word FROM words",
    "union_sources": r"""WITH w AS (
  SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) FROM benchmark)
SELECT word, count(*)::BIGINT AS n FROM w GROUP BY word""",
    "stream_term_counts": w(*DOC) + "SELECT unit_id, idx, cnt FROM counts",
    "long_units": """SELECT conv_id, turn FROM conversations WHERE length(replace(text, chr(10), '')) > 2""",
    "top_words_per_lang": r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents),
f AS (SELECT lang, word, count(*)::BIGINT AS n FROM w GROUP BY 1, 2)
SELECT lang, word, n FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word ASC) <= 5""",
    "first_clusters": w(*DOC, WEIGHTS, COS_PAIRS, COMPONENTS, recursive=True) + """,
sz AS (SELECT component, count(*)::BIGINT AS cluster_size FROM comp GROUP BY component HAVING count(*) > 15),
firsts AS (SELECT component FROM sz ORDER BY component LIMIT 2)
SELECT c.unit_id, c.component AS cluster_id, sz.cluster_size FROM comp c JOIN sz USING (component)
WHERE c.component IN (SELECT component FROM firsts)""",
    "class_means": KNN + ",\n" + CONF + ",\n" + REPORT + """SELECT round(avg(precision), 6) AS macro_precision,
  round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rep""",
    "nb_per_cluster": w(*DOC, WEIGHTS, COS_PAIRS, COMPONENTS, recursive=True) + """,
szc AS (SELECT component FROM comp GROUP BY component HAVING count(*) > 15),
units AS (SELECT c.unit_id, c.component AS cluster_id, l.toxic AS label
  FROM comp c JOIN szc USING (component) JOIN labels l ON l.doc_id = c.unit_id),
sp AS (SELECT *, substr(md5(unit_id::VARCHAR || ':7'), 1, 8) < '40000000' AS is_test FROM units),
sc AS (SELECT unit_id, cluster_id AS scope, label, is_test FROM sp
  UNION ALL SELECT unit_id, -1, label, is_test FROM sp),
tr AS (SELECT * FROM sc WHERE NOT is_test), te AS (SELECT * FROM sc WHERE is_test),
vsize AS (SELECT count(*) AS v FROM vocab),
pt AS (SELECT tr.scope, tr.label, c.idx, sum(c.cnt) AS c FROM counts c JOIN tr USING (unit_id) GROUP BY 1, 2, 3),
pc AS (SELECT tr.scope, tr.label, sum(c.cnt) AS tot FROM counts c JOIN tr USING (unit_id) GROUP BY 1, 2),
lp AS (SELECT pt.scope, pt.label, pt.idx, ln(pt.c + 1.0) - ln(pc.tot + vsize.v) AS lp
  FROM pt JOIN pc USING (scope, label), vsize),
ns AS (SELECT scope, count(*) AS n FROM tr GROUP BY 1),
pr AS (SELECT tr.scope, tr.label, ln(count(*)) - ln(max(ns.n)) AS prior FROM tr JOIN ns USING (scope) GROUP BY 1, 2),
prd AS (SELECT pr.*, ln(pc.tot + vsize.v) AS den FROM pr JOIN pc USING (scope, label), vsize),
tu AS (SELECT te.scope, te.unit_id, c.idx, c.cnt FROM counts c JOIN te USING (unit_id)),
cand AS (SELECT tu.*, prd.label, prd.prior, prd.den FROM tu JOIN prd USING (scope)),
seen AS (SELECT cand.*, lp.lp FROM cand LEFT JOIN lp USING (scope, label, idx)),
scores AS (SELECT scope, unit_id, label, coalesce(sum(cnt * lp), 0)
    + sum(CASE WHEN lp IS NULL THEN cnt ELSE 0 END) * (ln(1.0) - max(den)) + max(prior) AS score
  FROM seen GROUP BY 1, 2, 3),
best AS (SELECT scope, unit_id, label AS prediction FROM scores
  QUALIFY row_number() OVER (PARTITION BY scope, unit_id ORDER BY score DESC, label ASC) = 1)
SELECT te.scope, te.unit_id, te.label, best.prediction FROM te JOIN best USING (scope, unit_id)""",
    "line_slice": r"""WITH d AS (SELECT doc_id, doc_id % 4 AS file, coalesce(text, '') AS t FROM documents),
u AS (SELECT file, doc_id, n, coalesce(sum(n) OVER (PARTITION BY file ORDER BY doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM (SELECT *, length(t) - length(replace(t, chr(10), '')) + 1 AS n FROM d)),
f AS (SELECT file, string_split_regex(string_agg(t, chr(10) ORDER BY doc_id),
                                      '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]') AS lines FROM d GROUP BY file)
SELECT u.file, doc_id, array_to_string(lines[(first + n // 4 + 1)::BIGINT:(first + n - n // 4)::BIGINT], chr(10)) AS raw
FROM u JOIN f USING (file)""",
    "parse_tokens": f"""SELECT conv_id % 8 AS bucket,
  row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS pos,
  CASE WHEN text IN ({NA_LIST}) THEN NULL ELSE text END AS token, length(role)::INTEGER AS kind,
  turn::INTEGER AS line, (conv_id % 5)::INTEGER AS col FROM conversations""",
    "parse_error_rows": r"""WITH l AS (SELECT conv_id AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS v FROM conversations),
long AS (SELECT file, count(*) AS n FROM l WHERE length(v) - length(replace(v, ',', '')) > 3 GROUP BY file),
m AS (SELECT conv_id AS file, count(*) FILTER (role = 'user') AS b, count(*) FILTER (role IS DISTINCT FROM 'user') AS e
      FROM conversations GROUP BY 1)
SELECT file, reason FROM (
  SELECT file, CASE WHEN n IS NOT NULL THEN 'Error tokenizing data: ' || n || ' rows with too many fields'
    WHEN b <> e THEN 'has different number of start and end in parsed!!!'
    WHEN b = 0 THEN 'no functions found!' END AS reason
  FROM m LEFT JOIN long USING (file)) WHERE reason IS NOT NULL""",
}

# ------------------------------------------------------------ token files to clusters

CORPUS = f"""WITH lines AS (
  SELECT conv_id, turn, role, i, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS no FROM (
    SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM conversations)),
rows_ AS (
  SELECT conv_id, turn, i, w, word AS token, no AS line FROM (
    SELECT *, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS w FROM lines)
  WHERE word <> ''
  UNION ALL SELECT conv_id, turn, CASE WHEN role = 'user' THEN -1 ELSE 1000000000 END, 0,
    CASE WHEN role = 'user' THEN 'BEGIN_METHOD' ELSE 'END_METHOD' END, NULL FROM conversations),
tok AS (SELECT * FROM (SELECT conv_id::VARCHAR AS file, token, line,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn, i, w) - 1 AS pos FROM rows_) WHERE token NOT IN ({NA_LIST})),
chk AS (SELECT file, count_if(token = 'BEGIN_METHOD') AS b, count_if(token = 'END_METHOD') AS e, count(line) AS n FROM tok GROUP BY file),
bs AS (SELECT file, pos AS begin_pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM tok WHERE token = 'BEGIN_METHOD'),
es AS (SELECT file, pos AS end_pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM tok WHERE token = 'END_METHOD'),
un AS (SELECT bs.file, bs.k::INTEGER AS k, begin_pos, end_pos FROM bs JOIN es USING (file, k)
       WHERE file IN (SELECT file FROM chk WHERE b = e AND b > 0 AND n > 0)),
lastl AS (SELECT file, arg_max(line, pos) FILTER (WHERE line IS NOT NULL) AS last_line FROM tok GROUP BY file),
ul AS (SELECT u.*, s.line AS start_line, coalesce(e.line, l.last_line) AS end_line FROM un u
       LEFT JOIN tok s ON s.file = u.file AND s.pos = begin_pos + 1
       LEFT JOIN tok e ON e.file = u.file AND e.pos = end_pos + 2 LEFT JOIN lastl l ON l.file = u.file),
rep AS (SELECT conv_id::VARCHAR AS file, no AS start_line, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (
          SELECT conv_id, no, unnest([CASE WHEN length(line) - length(replace(line, ',', '')) >= 2 THEN 'sql_commas' END,
                                      CASE WHEN line LIKE '%.' THEN 'stop' END]) AS tag FROM lines)
        WHERE tag IS NOT NULL GROUP BY 1, 2),
lab AS (SELECT ul.*, coalesce(tags, '') AS tags, (coalesce(tags, '') LIKE '%sql%')::INTEGER AS gt
        FROM ul LEFT JOIN rep USING (file, start_line)),
txt AS (SELECT u.file, u.k, trim(regexp_replace(regexp_replace(lower(string_agg(t.token, ' ' ORDER BY t.pos)),
                 '[^\\p{{L}}\\p{{N}} _\\-]', '', 'g'), ' +', ' ', 'g')) AS text
        FROM un u JOIN tok t ON t.file = u.file AND t.pos BETWEEN begin_pos AND end_pos GROUP BY 1, 2),
src AS (SELECT conv_id::VARCHAR AS file, list(line ORDER BY no) AS src FROM lines GROUP BY 1),
units_ AS (SELECT row_number() OVER (ORDER BY file, k) - 1 AS unit_id, lab.*, coalesce(text, '') AS text,
             coalesce(array_to_string(src[start_line + 1:end_line], chr(10)), '') AS raw
           FROM lab LEFT JOIN txt USING (file, k) JOIN src USING (file))"""


def _on_units(t: float, *more: str) -> str:
    """The document steps over the run's units, with its settings."""
    steps = ",\n".join([WORDS, FREQ, VOCAB, COUNTS, WEIGHTS, COS_PAIRS, COMPONENTS, *more])
    steps = steps.replace("FROM documents)", "FROM units_)").replace("doc_id AS unit_id", "unit_id").replace("lower(text)", "lower(text)")
    return CORPUS.replace("WITH lines", "WITH RECURSIVE lines", 1) + ",\n" + steps.replace(">= 20", ">= 5").replace("< 0.4", f"< {t}")


def _on_sample(kind: str) -> str:
    choice = "choice AS (SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':3'), doc_id LIMIT 300)"
    kept = f"used AS (SELECT * FROM weights WHERE unit_id {kind} (SELECT doc_id FROM choice))"
    pairs = COS_PAIRS.replace("FROM weights a JOIN weights b", "FROM used a JOIN used b")
    return w(*DOC, WEIGHTS, choice, kept, pairs) + " SELECT i, j, round(dist, 6) AS dist FROM pairs"


REAL_PAIRS = """nnz AS (SELECT unit_id, count(*) AS n FROM counts GROUP BY 1),
met AS (SELECT a.unit_id AS i, b.unit_id AS j, count(*) AS k, count_if(a.cnt = b.cnt) AS e
         FROM counts a JOIN counts b ON a.idx = b.idx AND a.unit_id < b.unit_id GROUP BY 1, 2)
SELECT i, j, round((p.n + q.n - k - e) / (p.n + q.n - k), 6) AS dist FROM met JOIN nnz p ON p.unit_id = i JOIN nnz q ON q.unit_id = j
WHERE (p.n + q.n - k - e) / (p.n + q.n - k) < 0.5"""

ORACLES |= {
    "pair_distance_jaccard_real": w(*DOC, REAL_PAIRS),
    "pair_distance_jaccard_binary": w(*DOC, REAL_PAIRS.replace("count_if(a.cnt = b.cnt)", "count(*)")),
    "subsample_words": """WITH l AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS ws FROM documents),
x AS (SELECT unit_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM l),
f AS (SELECT word, count(*) / sum(count(*)) OVER () AS f FROM x GROUP BY word),
kept AS (SELECT unit_id, word, pos FROM x JOIN f USING (word)
         WHERE f <= 1e-3 OR ('0x' || substr(md5(unit_id || ':' || pos || ':1'), 1, 8))::BIGINT / 4294967296.0 < sqrt(1e-3 / f))
SELECT unit_id, count(pos) AS n, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS words
FROM l LEFT JOIN kept USING (unit_id) GROUP BY unit_id""",
    "label_join": CORPUS + " SELECT file, k, begin_pos, end_pos, start_line, end_line, tags, gt FROM lab",
    "run_errors": CORPUS + """ SELECT file, CASE WHEN b <> e THEN 'has different number of start and end in parsed!!!'
  WHEN b = 0 THEN 'no functions found!' ELSE 'no tokenized found!' END AS reason FROM chk WHERE NOT (b = e AND b > 0 AND n > 0)""",
    "staged_run": _on_units(0.4) + " SELECT unit_id, component AS cluster_id FROM comp",
    "cluster_listing": _on_units(1.15 * 1.15 / 2) + """,
sz AS (SELECT component, count(*) AS size, avg(gt) AS gt_rate FROM comp JOIN units_ USING (unit_id) GROUP BY 1 HAVING count(*) > 2)
SELECT component AS cluster_id, unit_id, row_number() OVER (PARTITION BY component ORDER BY unit_id) - 1 AS position,
  size, size > 15 AS interesting, round(gt_rate, 6) AS gt_rate, gt, tags, file, start_line, end_line, raw
FROM comp JOIN sz USING (component) JOIN units_ USING (unit_id)""",
    "pairs_on_sample": _on_sample("IN"),
    "sample_rest": _on_sample("NOT IN"),
}


def _approx_pairs(t: float) -> str:
    """Exact pairs that agree in a band of minimum hashes (factors and offsets as the operator's rule gives them)."""
    from kindred.operators.pairs import MERSENNE, banding, hash_parameters
    rows, bands = banding(1 - t, 0.97, 96)
    given = ", ".join(f"({n}, {a}::BIGINT, {b}::BIGINT)" for n, (a, b) in enumerate(hash_parameters(rows * bands)))
    return f"""hashes(h, a, b) AS (VALUES {given}),
lows AS (SELECT unit_id, h, min((a * (idx % {MERSENNE}) + b) % {MERSENNE}) AS low FROM counts, hashes GROUP BY ALL),
member AS (SELECT unit_id, h // {rows} AS band, list(low ORDER BY h) AS sig FROM lows GROUP BY ALL),
near AS (SELECT DISTINCT x.unit_id AS i, y.unit_id AS j FROM member x JOIN member y
         ON x.band = y.band AND x.sig = y.sig AND x.unit_id < y.unit_id)"""


ORACLES["pair_distance_jaccard_approx"] = w(*DOC, JAC_PAIRS, _approx_pairs(0.5)) \
    + "SELECT i, j, round(dist, 6) AS dist FROM jpairs SEMI JOIN near USING (i, j)"
