"""SQL for DuckDB of the training-data queries that SQL can express."""

WORD = r"[\p{L}\p{Nd}]+"
SPACE = r"[\t\n\x0b\f\r\x{85}\p{Z}]"

_COUNTING = "SELECT * FROM patents QUALIFY row_number() OVER (PARTITION BY patent_id ORDER BY ingested_at DESC) = 1"

SQL: dict[str, str] = {}

SQL["p1_found"] = rf"""
WITH counting AS ({_COUNTING}),
paragraphs AS (SELECT patent_id, unnest(description_paragraphs) AS p, unnest(range(len(description_paragraphs))) AS paragraph_no FROM counting WHERE patent_id IS NOT NULL)
SELECT patent_id, paragraph_no::INT AS paragraph_no FROM paragraphs WHERE len(regexp_extract_all(p, '[^\t\n\x0b\f\r\x{{85}}\p{{Z}}]+')) > 500
"""

SQL["p1_rebuilt"] = rf"""
WITH counting AS ({_COUNTING}),
paragraphs AS (SELECT patent_id, unnest(description_paragraphs) AS p, unnest(range(len(description_paragraphs))) AS paragraph_no FROM counting WHERE patent_id IS NOT NULL)
SELECT patent_id, paragraph_no::INT AS paragraph_no, md5(p) AS digest, len(regexp_extract_all(p, '[^\t\n\x0b\f\r\x{{85}}\p{{Z}}]+')) AS words, true AS fits, true AS overlaps
FROM paragraphs WHERE len(regexp_extract_all(p, '[^\t\n\x0b\f\r\x{{85}}\p{{Z}}]+')) > 500
"""

SQL["p2_found"] = """
WITH r AS (
  SELECT DISTINCT record_id, embedding::DOUBLE[] AS e FROM search_records
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT record_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))::DOUBLE[64] AS v FROM r),
pairs AS (SELECT a.record_id AS a, b.record_id AS b, array_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.record_id <> b.record_id),
near AS (SELECT a, b FROM pairs WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS record_id_a, greatest(a, b) AS record_id_b FROM near
"""

_TERMS = r"""
WITH r AS (SELECT DISTINCT record_id, patent_id, lower(concat_ws(' ', title, text)) AS t FROM search_records),
w AS (SELECT record_id, patent_id, unnest(regexp_extract_all(t, '\p{L}+')) AS term FROM r),
tf AS (SELECT record_id, patent_id, term, count(*) AS n FROM w WHERE length(term) >= 3 GROUP BY ALL),
stats AS (SELECT term, sum(n)::BIGINT AS collection_n, least(4, count(DISTINCT patent_id))::INT AS groups FROM tf GROUP BY term),
sizes AS (SELECT record_id, sum(n) AS size FROM tf GROUP BY record_id),
total AS (SELECT sum(n) AS total FROM tf)
"""

SQL["p3_found"] = _TERMS + "SELECT record_id, term FROM tf JOIN stats USING (term) WHERE n >= 3 AND groups <= 3"

SQL["p3_scores"] = _TERMS + """, v AS (
  SELECT record_id, term, n, collection_n, groups, size::DOUBLE AS size, total::DOUBLE AS total, 1000.0::DOUBLE * collection_n / total AS a
  FROM tf JOIN stats USING (term) JOIN sizes USING (record_id), total
)
SELECT record_id, term, n, collection_n, groups,
  round((ln((n + a) / (size + 1000.0::DOUBLE - n - a)) - ln((collection_n - n + a) / (total - size + 1000.0::DOUBLE - (collection_n - n) - a))) / sqrt(1 / (n + a) + 1 / (collection_n - n + a)), 6) AS z
FROM v
"""

_SETS = rf"""
WITH RECURSIVE counting AS ({_COUNTING}),
texts AS (SELECT patent_id, regexp_extract_all(lower(concat_ws(' ', abstract, array_to_string(list_filter(claims_raw, lambda x: x IS NOT NULL), ' '), array_to_string(list_filter(description_paragraphs, lambda x: x IS NOT NULL), ' '))), '{WORD}') AS w FROM counting WHERE patent_id IS NOT NULL),
"""

SQL["p4_found"] = _SETS + """
sets AS (SELECT patent_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM texts WHERE len(w) >= 3),
each AS (SELECT patent_id, unnest(s) AS g FROM sets),
common AS (SELECT a.patent_id AS a, b.patent_id AS b, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.patent_id < b.patent_id GROUP BY ALL)
SELECT a AS patent_id_a, b AS patent_id_b FROM common JOIN sets x ON x.patent_id = a JOIN sets y ON y.patent_id = b WHERE n >= 0.7::DOUBLE * (len(x.s) + len(y.s) - n) - 1e-9
"""

SQL["p4_groups"] = _SETS + """
sets AS (SELECT patent_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))))) AS s FROM texts WHERE len(w) >= 5),
classes AS (SELECT s, min(patent_id) AS c FROM sets GROUP BY s),
each AS (SELECT c, unnest(s) AS g FROM classes),
common AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.c <> b.c GROUP BY ALL),
linked AS (SELECT a, b FROM common JOIN classes x ON x.c = a JOIN classes y ON y.c = b WHERE n >= 0.8::DOUBLE * (len(x.s) + len(y.s) - n) - 1e-9),
reach(a, b) AS (SELECT c, c FROM classes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
named AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS links FROM linked GROUP BY a)
SELECT sets.patent_id, least AS "group", coalesce(links, 0) AS links FROM sets JOIN classes ON classes.s = sets.s JOIN named ON named.a = c LEFT JOIN degrees ON degrees.a = c
"""

_PLACES = """
WITH h AS (
  SELECT run_id, record_id,
    max(CASE WHEN score::VARCHAR NOT LIKE '%nan' THEN score END) AS s, max(CASE WHEN rerank_score::VARCHAR NOT LIKE '%nan' THEN rerank_score END) AS r,
    min(CASE WHEN bm25_rank >= 1 THEN bm25_rank END) AS b, min(CASE WHEN vector_rank >= 1 THEN vector_rank END) AS v
  FROM hits WHERE run_id IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL
), p AS (
  SELECT run_id, record_id,
    CASE WHEN s IS NULL THEN 1 + count(s) OVER w ELSE rank() OVER (PARTITION BY run_id ORDER BY s DESC NULLS LAST) END AS place_score,
    CASE WHEN r IS NULL THEN 1 + count(r) OVER w ELSE rank() OVER (PARTITION BY run_id ORDER BY r DESC NULLS LAST) END AS place_rerank_score,
    CASE WHEN b IS NULL THEN 1 + count(b) OVER w ELSE rank() OVER (PARTITION BY run_id ORDER BY b NULLS LAST) END AS place_bm25_rank,
    CASE WHEN v IS NULL THEN 1 + count(v) OVER w ELSE rank() OVER (PARTITION BY run_id ORDER BY v NULLS LAST) END AS place_vector_rank
  FROM h WINDOW w AS (PARTITION BY run_id)
), q AS (
  SELECT *, place_score + place_rerank_score + place_bm25_rank + place_vector_rank AS place_sum,
    0.0::DOUBLE + 1 / (60.0::DOUBLE + place_score) + 1 / (60.0::DOUBLE + place_rerank_score) + 1 / (60.0::DOUBLE + place_bm25_rank) + 1 / (60.0::DOUBLE + place_vector_rank) AS fused FROM p
), z AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY place_sum) AS sum_place, row_number() OVER (PARTITION BY run_id ORDER BY fused DESC, record_id) AS place FROM q)
"""

SQL["p5_found"] = _PLACES + "SELECT run_id, record_id FROM z WHERE sum_place <= 3"
SQL["p5_ranking"] = _PLACES + "SELECT run_id, record_id, place_score, place_rerank_score, place_bm25_rank, place_vector_rank, place_sum::BIGINT AS place_sum, sum_place, fused, place FROM z"

SQL["p6_found"] = """
WITH RECURSIVE f AS (SELECT DISTINCT lower(trim(query_id)) AS q, nullif(lower(trim(patent_id)), '') AS p FROM feature_rows WHERE lower(trim(query_id)) <> ''),
e AS (SELECT DISTINCT a.q AS a, b.q AS b FROM f a JOIN f b ON a.p = b.p),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS query_id, min(b) AS group_id FROM reach GROUP BY a HAVING count(*) > 1
"""

SQL["p6_together"] = """
WITH RECURSIVE f AS (SELECT lower(trim(query_id)) AS q, nullif(lower(trim(patent_id)), '') AS p FROM feature_rows WHERE lower(trim(query_id)) <> ''),
d AS (SELECT DISTINCT q, p FROM f),
e AS (SELECT DISTINCT a.q AS a, b.q AS b FROM d a JOIN d b ON a.p = b.p),
reach(a, b) AS (SELECT q, q FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
named AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT component, count(*) AS rows, true AS together FROM f JOIN named ON q = a GROUP BY component
"""

SQL["p7_found"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM eval_passages),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
"""

SQL["p8_found"] = r"""
WITH sizes AS (SELECT lower(trim(source)) AS source, sum(len(regexp_extract_all(text, '[^\t\n\x0b\f\r\x{85}\p{Z}]+'))) AS n FROM documents GROUP BY 1),
listed AS (SELECT lower(trim(source)) AS source, max(weight) AS w, max(coalesce(max_repeats, 1)) AS m FROM source_weights GROUP BY 1),
j AS (SELECT l.source, w, m, coalesce(n, 0) AS n FROM listed l LEFT JOIN sizes s ON s.source = l.source),
t AS (SELECT sum(n) AS total, sum(w) AS weight FROM j)
SELECT j.source FROM j, t WHERE n * m < t.total * j.w / t.weight
"""

SQL["p8_sources"] = r"""
WITH sizes AS (SELECT lower(trim(source)) AS source, count(*) AS documents, sum(len(regexp_extract_all(coalesce(text, ''), '[^\t\n\x0b\f\r\x{85}\p{Z}]+'))) AS n FROM documents GROUP BY 1),
listed AS (SELECT lower(trim(source)) AS source, max(weight) AS w, max(coalesce(max_repeats, 1)) AS m FROM source_weights GROUP BY 1),
j AS (SELECT l.source, w, m, coalesce(documents, 0) AS documents, coalesce(n, 0) AS n FROM listed l LEFT JOIN sizes s ON s.source = l.source),
t AS (SELECT sum(n) AS total, sum(w) AS weight FROM j)
SELECT j.source, documents, n::BIGINT AS size, m::INT AS max_repeats, round(w / weight, 9) AS target_share, round(total::DOUBLE * w / weight, 3) AS target_size, true AS kept FROM j, t
"""
