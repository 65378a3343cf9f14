"""The same results in DuckDB's SQL."""

from ..functions.text import TERM_PATTERN

_P = TERM_PATTERN.replace("'", "''")

_LOCAL = """
rows AS (SELECT DISTINCT document_id, segment_id, field, journal, words FROM positioned_document WHERE document_id IS NOT NULL),
tok AS (SELECT document_id, replace(lower(replace(w.text, 'İ', 'i̇')), 'ß', 'ss') AS term FROM (SELECT document_id, unnest(words) AS w FROM rows) WHERE w.text IS NOT NULL AND trim(w.text) <> ''),
loc AS (SELECT document_id, term, count(*) AS f FROM tok WHERE regexp_matches(term, '\\p{L}') GROUP BY 1, 2),
n AS (SELECT count(DISTINCT document_id)::DOUBLE AS n FROM positioned_document),
"""

# Paragraph by paragraph, the runs of three terms as one string each.
_RUNS = f"""
par AS (SELECT DISTINCT record_id, generate_subscripts(abstract_paragraphs_clean, 1) AS k, unnest(abstract_paragraphs_clean) AS paragraph FROM structured_document),
lists AS (SELECT record_id, list_transform(regexp_extract_all(paragraph, '{_P}'), lambda x: replace(lower(replace(x, 'İ', 'i̇')), 'ß', 'ss')) AS t FROM par WHERE paragraph IS NOT NULL),
runs AS (SELECT DISTINCT record_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS run FROM lists WHERE len(t) > 2),
sizes AS (SELECT record_id, count(*) AS n FROM runs GROUP BY 1),
met AS (SELECT x.record_id AS a, y.record_id AS b, count(*) AS k FROM runs x JOIN runs y ON x.run = y.run AND x.record_id < y.record_id GROUP BY 1, 2),
pairs AS (SELECT a, b, k, p.n AS na, q.n AS nb FROM met JOIN sizes p ON a = p.record_id JOIN sizes q ON b = q.record_id WHERE k >= 0.6 * (p.n + q.n - k) - 1e-9)
"""

ORACLE = {
    "p1_found": f"WITH {_RUNS} SELECT a AS record_id_a, b AS record_id_b FROM pairs",
    "p1_classes": f"""
WITH {_RUNS},
same AS (SELECT record_id, coalesce((SELECT min(a) FROM pairs WHERE b = record_id AND k = na AND k = nb), record_id) AS class_id FROM sizes),
links AS (SELECT DISTINCT least(s.class_id, t.class_id) AS c, greatest(s.class_id, t.class_id) AS d FROM pairs JOIN same s ON a = s.record_id JOIN same t ON b = t.record_id WHERE s.class_id <> t.class_id),
degree AS (SELECT class_id, count(*) AS links FROM (SELECT c AS class_id FROM links UNION ALL SELECT d FROM links) GROUP BY 1)
SELECT record_id, class_id, count(*) OVER (PARTITION BY class_id) AS copies, coalesce(links, 0) AS links FROM same LEFT JOIN degree USING (class_id)
""",
    "p2_found": f"""
WITH par AS (SELECT DISTINCT record_id, generate_subscripts(abstract_paragraphs_clean, 1) AS k, unnest(abstract_paragraphs_clean) AS paragraph FROM structured_document),
tok AS (SELECT record_id, replace(lower(replace(unnest(regexp_extract_all(paragraph, '{_P}')), 'İ', 'i̇')), 'ß', 'ss') AS term FROM par WHERE paragraph IS NOT NULL),
n AS (SELECT count(DISTINCT record_id) AS n FROM structured_document)
SELECT term, count(*) AS total_frequency, count(DISTINCT record_id) AS document_frequency,
  CASE WHEN count(DISTINCT record_id) < 3 THEN 'rare' WHEN count(DISTINCT record_id) > 0.3 * any_value(n) THEN 'common' ELSE 'keep' END AS mark
FROM tok, n GROUP BY term
""",
    "p7_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(replace(text, 'İ', 'i̇')), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(replace(lower(replace(text, 'İ', 'i̇')), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS w FROM eval_item WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS win FROM d WHERE len(w) >= 12),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS win FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (win)
""",
    "p3_found": f"""
WITH {_LOCAL}
spread AS (SELECT term, count(*) AS df FROM loc GROUP BY 1 HAVING count(*) >= 2),
scored AS (SELECT document_id, term, round(f * log10(n / df), 6) AS score FROM loc JOIN spread USING (term), n)
SELECT document_id, term FROM scored
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, term) <= 3
""",
    "p3_log_entropy": f"""
WITH {_LOCAL}
spread AS (SELECT term, count(*) AS df, sum(f) AS cf, sum(f * ln(f)) AS flnf FROM loc GROUP BY 1 HAVING count(*) >= 2),
scored AS (SELECT document_id, term, f, df,
  round(log10(1 + f) * (1 - CASE WHEN n > 1 THEN (ln(cf) - flnf / cf) / ln(n) ELSE 0 END), 6) AS score
  FROM loc JOIN spread USING (term), n)
SELECT document_id, term, f, df, score FROM scored
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, term) <= 3
""",
}
