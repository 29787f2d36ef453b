"""SQL for DuckDB of the engine's queries."""

from claimloom.functions.analyzer import _STEP2, _STEP3, _STEP4, SYNONYM_GROUPS

_S = r"[\s\x0b\x{85}\p{Z}\x{1c}-\x{1f}]"
_NS = r"[^\s\x0b\x{85}\p{Z}\x{1c}-\x{1f}]"
_BARE = "record_id, patent_id, record_type, title, text, classification_raw, claim_number, abstract, classification_section, classification_class, classification_subclass, is_independent, paragraph_start, paragraph_end"
_TOKENS = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"
_STOP = ", ".join(f"'{w}'" for w in "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


_SYNONYM = "CASE t " + " ".join(f"WHEN '{w}' THEN '{g[0]}'" for g in SYNONYM_GROUPS for w in g[1:]) + " ELSE t END"


def _terms(c: str, synonyms: bool = True) -> str:
    """A text's terms before they are stemmed."""
    tokens = f"regexp_extract_all(lower(coalesce({c}, '')), '{_TOKENS}')"
    if synonyms:
        tokens = f"list_transform({tokens}, lambda t: {_SYNONYM})"
    return f"list_filter(list_transform({tokens}, lambda t: regexp_replace(t, '[''’]s$', '')), lambda t: t NOT IN ({_STOP}) AND t <> '')"


def _kinds(x: str) -> str:
    """A word as a string of c and v; y is a vowel after a consonant."""
    k = f"regexp_replace(translate({x}, 'bcdfghjklmnpqrstvwxzaeiou', '{'c' * 20}{'v' * 5}'), '^y', 'c')"
    for _ in range(3):
        k = f"replace(replace({k}, 'cy', 'cv'), 'vy', 'vc')"
    return k


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _more(x: str, n: int) -> str:
    """Whether a stem's measure is above n."""
    return f"regexp_matches({_kinds(x)}, '{'v+c+' * (n + 1)}')"


def _closed(x: str) -> str:
    return f"(length({x}) >= 3 AND regexp_matches({_kinds(x)}, 'cvc$') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _longest(table: dict[str, str], least: int) -> str:
    """The longest ending of x in the table is replaced where the stem before it has measure above least."""
    cases = "".join(f" WHEN ends_with(x, '{e}') THEN CASE WHEN {_more(_cut('x', len(e)), least)}{extra} THEN {_cut('x', len(e))} || '{new}' ELSE x END" for e, new, extra in sorted(((e, n, " AND right(left(x, length(x) - 3), 1) IN ('s', 't')" if e == "ion" else "") for e, n in table.items()), key=lambda r: -len(r[0])))
    return f"CASE{cases} ELSE x END"


#: CTEs after vocab (w): stems (w, s), by Porter's published algorithm.
_STEMS = f"""
s1 AS (SELECT w, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut('w', 1)} ELSE w END AS x FROM vocab WHERE length(w) > 2 AND regexp_matches(w, '^[a-z]+$')),
s2 AS (SELECT w, x, CASE WHEN ends_with(x, 'eed') THEN NULL WHEN ends_with(x, 'ed') AND contains({_kinds(_cut('x', 2))}, 'v') THEN {_cut('x', 2)} WHEN ends_with(x, 'ing') AND contains({_kinds(_cut('x', 3))}, 'v') THEN {_cut('x', 3)} END AS y FROM s1),
s3 AS (SELECT w, CASE WHEN ends_with(x, 'eed') THEN CASE WHEN {_more(_cut('x', 3), 0)} THEN {_cut('x', 1)} ELSE x END WHEN y IS NULL THEN x WHEN right(y, 2) IN ('at', 'bl', 'iz') THEN y || 'e'
  WHEN length(y) > 1 AND right(y, 1) = substr(y, length(y) - 1, 1) AND right({_kinds('y')}, 1) = 'c' AND right(y, 1) NOT IN ('l', 's', 'z') THEN {_cut('y', 1)} WHEN {_more('y', 0)} AND NOT {_more('y', 1)} AND {_closed('y')} THEN y || 'e' ELSE y END AS x FROM s2),
s4 AS (SELECT w, CASE WHEN ends_with(x, 'y') AND contains({_kinds(_cut('x', 1))}, 'v') THEN {_cut('x', 1)} || 'i' ELSE x END AS x FROM s3),
s5 AS (SELECT w, {_longest(_STEP2, 0)} AS x FROM s4),
s6 AS (SELECT w, {_longest(_STEP3, 0)} AS x FROM s5),
s7 AS (SELECT w, {_longest(dict.fromkeys(_STEP4, ''), 1)} AS x FROM s6),
s8 AS (SELECT w, CASE WHEN ends_with(x, 'e') AND ({_more(_cut('x', 1), 1)} OR {_more(_cut('x', 1), 0)} AND NOT {_closed(_cut('x', 1))}) THEN {_cut('x', 1)} ELSE x END AS x FROM s7),
s9 AS (SELECT w, CASE WHEN ends_with(x, 'll') AND {_more('x', 1)} THEN {_cut('x', 1)} ELSE x END AS x FROM s8),
stems AS (SELECT vocab.w, coalesce(x, vocab.w) AS s FROM vocab LEFT JOIN s9 USING (w))"""


def _normal(c: str) -> str:
    c = rf"regexp_replace(coalesce({c}, ''), '\p{{Cf}}', '', 'g')"
    c = rf"regexp_replace({c}, '([a-z])(FIGS?\.)', '\1 \2', 'g')"
    c = rf"regexp_replace({c}, '\b(FIGS?\.){_S}*(\d)', '\1 \2', 'g')"
    return f"trim(regexp_replace({c}, '{_S}+', ' ', 'g'))"


_R = f"WITH r AS (SELECT DISTINCT {_BARE} FROM search_records)"
_P = "p AS (SELECT * FROM patents WHERE patent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patent_id ORDER BY ingested_at DESC) = 1)"

SQL: dict[str, str] = {}
SQL["project_fields"] = "SELECT DISTINCT record_id, patent_id, record_type, title, text, classification_raw, claim_number FROM search_records"


def _keyword(column: str, words: list[str]) -> str:
    """CTEs after r: hit (record_id), the records whose column holds a term of the words."""
    return f"""fd AS (SELECT record_id, unnest({_terms(column)}) AS w FROM r), kw AS (SELECT unnest({_terms("'" + ' '.join(words) + "'")}) AS w), vocab AS (SELECT w FROM fd UNION SELECT w FROM kw), {_STEMS},
hit AS (SELECT DISTINCT record_id FROM fd JOIN stems USING (w) WHERE s IN (SELECT s FROM kw JOIN stems USING (w)))"""


_HIT = "record_id IN (SELECT record_id FROM hit)"
for _name, _more_ctes, _where in (
    ("filter_prefix", "", "starts_with(classification_raw, 'B60C')"),
    ("filter_title_keyword", _keyword("title", ["tire", "wheels"]), _HIT),
    ("filter_abstract_keyword", _keyword("abstract", ["rubber", "deflated"]), _HIT),
    ("filter_record_types", "", "record_type IN ('claim', 'summary')"),
    ("filter_independent", "", "is_independent"),
    ("filters_combined", _keyword("title", ["tire"]), f"starts_with(classification_raw, 'B60') AND {_HIT} AND record_type = 'claim' AND is_independent"),
    ("filter_exact_title", "", "title = (SELECT min(title) FROM search_records)"),
    ("filter_exclude_patent", "", "patent_id IS DISTINCT FROM (SELECT min(patent_id) FROM search_records)"),
):
    SQL[_name] = f"{_R}{', ' if _more_ctes else ''}{_more_ctes} SELECT record_id FROM r WHERE {_where}"

_ENTRIES = f"WITH {_P}, e AS (SELECT patent_id, unnest(claims_raw) AS entry, unnest(range(len(claims_raw)))::INT AS pos FROM p)"
SQL["normalize_claims"] = f"{_ENTRIES} SELECT patent_id, pos, {_normal('entry')} AS normal, {_normal('entry')} = '' AS blank FROM e"
SQL["word_counts"] = f"WITH {_P} SELECT patent_id, len(regexp_extract_all(coalesce(abstract, ''), '{_NS}+'))::INT AS words, abstract[1:400] AS preview FROM p"

_GAP = r"[\s\x0b\x{85}\p{Z}.:;,\-–—]"
_CANCEL = rf"(?i)^{_S}*(\d+)(?:{_GAP}+(\d+))?{_GAP}*\({_S}*cancell?ed{_S}*\)"
_SEGMENTS = rf"""{_ENTRIES},
m AS (
  SELECT patent_id, pos, entry, {_normal('entry')} AS t,
    TRY_CAST(nullif(regexp_extract(entry, '{_CANCEL}', 1), '') AS INT) AS lo, TRY_CAST(nullif(regexp_extract(entry, '{_CANCEL}', 2), '') AS INT) AS hi2,
    TRY_CAST(nullif(regexp_extract(entry, '^{_S}*(\d{{1,3}}){_S}*[.)](?:\D|$)', 1), '') AS INT) AS number
  FROM e
), o AS (
  SELECT *, coalesce(hi2, lo) AS hi, lo IS NOT NULL OR number IS NOT NULL OR coalesce(lag(lo IS NOT NULL OR regexp_matches(t, '\.["'')]?$')) OVER (PARTITION BY patent_id ORDER BY pos), true) AS opens
  FROM m WHERE t <> ''
), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY patent_id ORDER BY pos)::INT AS seg, CASE WHEN opens THEN coalesce(lo, number) END AS explicit FROM o)"""
_NUMBERED = rf"""{_SEGMENTS},
g AS (SELECT patent_id, seg, max(explicit) AS explicit, max(lo) AS lo, max(hi) AS hi, list(pos ORDER BY pos) AS fragments, trim(string_agg(entry, ' ' ORDER BY pos)) AS raw FROM s GROUP BY ALL),
f AS (
  SELECT *,
    first(CASE WHEN explicit IS NOT NULL THEN {{'n': explicit, 's': seg}} END IGNORE NULLS) OVER (PARTITION BY patent_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
    last(CASE WHEN explicit IS NOT NULL THEN {{'n': coalesce(hi, explicit), 's': seg}} END IGNORE NULLS) OVER (PARTITION BY patent_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst
  FROM g
), n AS (
  SELECT *, coalesce(explicit, CASE WHEN nxt.n - (nxt.s - seg) >= 1 THEN nxt.n - (nxt.s - seg) END, lst.n + seg - lst.s, seg)::INT AS num, {_normal('raw')} AS text FROM f
)"""
_ANY = rf"(?:any{_S}+one{_S}+of{_S}+|any{_S}+of{_S}+|either{_S}+of{_S}+)?"
_NUMS = rf"((?:\d|{_S}|[,;–—\-])+(?:{_S}*(?:to|through|and|or){_S}*\d+)*)"
_STRONG = rf"(?i)(?:according to|as claimed in|as recited in|as set forth in|as defined in|defined in|recited in|set forth in){_S}+{_ANY}(?:claims?{_S}+)?{_NUMS}"
_WEAK = rf"(?i)\b(?:of|in){_S}+{_ANY}claims?{_S}+{_NUMS}"
_RANGE = rf"(?i)(\d+){_S}*(?:to|through|[-–—]){_S}*(\d+)"
_CLAIMS = rf"""{_NUMBERED},
spans AS (SELECT patent_id, seg, num, unnest(list_concat(regexp_extract_all(text, '{_STRONG}', 1), regexp_extract_all(text, '{_WEAK}', 1))) AS span FROM n WHERE lo IS NULL),
found AS (
  SELECT patent_id, seg, num, unnest(list_concat(
    flatten(list_transform(list_zip(regexp_extract_all(span, '{_RANGE}', 1), regexp_extract_all(span, '{_RANGE}', 2)), lambda z: CASE WHEN z[1]::INT <= z[2]::INT AND z[2]::INT - z[1]::INT < 100 THEN range(z[1]::INT, z[2]::INT + 1) ELSE [] END)),
    list_transform(regexp_extract_all(regexp_replace(span, '{_RANGE}', ' ', 'g'), '\d+'), lambda x: x::BIGINT))) AS dep
  FROM spans
), deps AS (SELECT patent_id, seg, list_sort(list_distinct(list(dep::INT))) AS depends_on FROM found WHERE dep <> num GROUP BY ALL),
c AS (
  SELECT CASE WHEN lo IS NOT NULL THEN format('{{}}:canceled:{{}}-{{}}', n.patent_id, lo, hi) ELSE format('{{}}:claim:{{}}', n.patent_id, num) END AS claim_id, n.patent_id, n.seg, num AS claim_number,
    CASE WHEN lo IS NOT NULL THEN 'canceled' WHEN explicit IS NULL THEN 'preamble_stripped' WHEN len(fragments) > 1 THEN 'rejoined_continuation' ELSE 'original_complete' END AS status,
    lo IS NULL AND depends_on IS NULL AS is_independent, fragments AS raw_fragment_indexes, explicit IS NULL AS number_inferred, coalesce(depends_on, []) AS depends_on, n.text
  FROM n LEFT JOIN deps ON deps.patent_id = n.patent_id AND deps.seg = n.seg
)"""
SQL["claim_segments"] = f"{_SEGMENTS} SELECT patent_id, seg, pos, explicit FROM s"
SQL["claim_numbers"] = f"{_NUMBERED} SELECT patent_id, seg, num AS number FROM n"
SQL["reconstruct_claims"] = f"{_CLAIMS} SELECT claim_id, patent_id, claim_number, status, is_independent, raw_fragment_indexes, number_inferred, depends_on FROM c"
SQL["reconstruction_stats"] = f"""{_CLAIMS}, j AS (SELECT count(*) AS k FROM (SELECT patent_id, list(claim_number ORDER BY seg) AS l FROM c WHERE status <> 'canceled' GROUP BY patent_id) WHERE l <> list_sort(l))
SELECT count(*) AS claims_total, count_if(is_independent)::BIGINT AS independent, count_if(len(depends_on) > 0)::BIGINT AS dependent, count_if(number_inferred)::BIGINT AS number_inferred,
  count_if(len(raw_fragment_indexes) > 1)::BIGINT AS multi_fragment, count_if(status = 'canceled')::BIGINT AS status_canceled, count_if(status = 'original_complete')::BIGINT AS status_original_complete,
  count_if(status = 'preamble_stripped')::BIGINT AS status_preamble_stripped, count_if(status = 'rejoined_continuation')::BIGINT AS status_rejoined_continuation, any_value(k) AS patents_with_out_of_order_numbering FROM c, j"""
SQL["claim_parents"] = f"{_CLAIMS}, x AS (SELECT claim_id, patent_id, unnest(depends_on) AS claim_number FROM c) SELECT x.claim_id, c.claim_id AS parent_id FROM x JOIN c ON c.patent_id = x.patent_id AND c.claim_number = x.claim_number AND c.status <> 'canceled'"
SQL["claim_invariant"] = "SELECT patent_id, 0 AS pos, 0::BIGINT AS uses FROM patents WHERE false"
# passages come from the given table: their greedy packing is no SQL
SQL["build_records"] = f"""{_CLAIMS},
t AS (SELECT patent_id, {_normal('title')} AS title, {_normal('abstract')} AS abstract, classification_raw FROM p),
d AS (SELECT DISTINCT patent_id, paragraph_start, paragraph_end, text FROM search_records WHERE record_type = 'description'),
u AS (
  SELECT patent_id, 'summary' AS suffix, 'summary' AS record_type, concat_ws(' ', nullif(title, ''), nullif(abstract, '')) AS text, NULL::INT AS claim_number, NULL::BOOLEAN AS is_independent, NULL::INT AS paragraph_start, NULL::INT AS paragraph_end FROM t
  UNION ALL SELECT patent_id, 'abstract', 'abstract', abstract, NULL, NULL, NULL, NULL FROM t
  UNION ALL SELECT patent_id, 'claim:' || claim_number, 'claim', text, claim_number, is_independent, NULL, NULL FROM c WHERE status <> 'canceled'
  UNION ALL SELECT patent_id, 'description:' || paragraph_start || '-' || paragraph_end, 'description', text, NULL, NULL, paragraph_start, paragraph_end FROM d
)
SELECT u.patent_id || ':' || suffix AS record_id, u.patent_id, record_type, title, text, classification_raw, claim_number, abstract, classification_raw[1:1] AS classification_section, classification_raw[1:3] AS classification_class,
  classification_raw[1:4] AS classification_subclass, is_independent, paragraph_start, paragraph_end FROM u JOIN t ON t.patent_id = u.patent_id WHERE text <> ''"""
SQL["chunk_passages"] = "SELECT DISTINCT patent_id, paragraph_start AS start, paragraph_end AS \"end\", text FROM search_records WHERE record_type = 'description'"

def _index(stem: bool = True) -> str:
    plain = "stems AS (SELECT w, w AS s FROM vocab)"
    return f"""{_R},
docs AS (SELECT record_id, 'text' AS field, {_terms('text', stem)} AS terms FROM r UNION ALL SELECT record_id, 'title', {_terms('title', stem)} FROM r),
sized AS (SELECT *, len(terms) AS dl FROM docs WHERE len(terms) > 0),
asked AS (SELECT query_id, {_terms('text', stem)} AS terms FROM eval_queries),
vocab AS (SELECT unnest(terms) AS w FROM sized UNION SELECT unnest(terms) FROM asked), {_STEMS if stem else plain},
post AS (SELECT field, s AS term, record_id, dl, count(*) AS tf FROM (SELECT field, record_id, dl, unnest(terms) AS w FROM sized) JOIN stems USING (w) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
st AS (SELECT field, count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM sized GROUP BY field)"""


def _bm25(stem: bool = True) -> str:
    return f"""{_index(stem)},
qt AS (SELECT query_id, s AS term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS w FROM asked) JOIN stems USING (w) GROUP BY ALL),
fs AS (
  SELECT query_id, record_id, field, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s
  FROM qt JOIN post USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL
), sc AS (SELECT query_id, record_id, round(max(s * CASE WHEN field = 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 4) AS score FROM fs GROUP BY ALL)"""


_INDEX, _BM25 = _index(), _bm25()
SQL["term_statistics"] = f"{_INDEX} SELECT field, term, df FROM df"
SQL["field_statistics"] = f"{_INDEX} SELECT field, n, round(avgdl, 9) AS avgdl FROM st"


def _top(source: str, k: int) -> str:
    return f"SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id)::INT AS rank FROM {source} QUALIFY rank <= {k}"


SQL["bm25_plain"] = f"{_bm25(False)} {_top('sc', 10)}"
SQL["bm25_keyword"] = f"{_BM25}, fs2 AS (SELECT DISTINCT record_id FROM post WHERE field = 'title' AND term IN ('tyre', 'wheel')), kept AS (SELECT * FROM sc WHERE record_id IN (SELECT record_id FROM fs2)) {_top('kept', 10)}"
SQL["posting_lists"] = f"{_INDEX} SELECT field, term, count(*) AS records, sum(tf)::BIGINT AS occurrences FROM post GROUP BY ALL"
SQL["bm25_topk"] = f"{_BM25} {_top('sc', 10)}"
SQL["bm25_filtered"] = f"{_BM25}, ok AS (SELECT record_id FROM r WHERE starts_with(classification_raw, 'B60') AND record_type = 'claim'), kept AS (SELECT * FROM sc WHERE record_id IN (SELECT record_id FROM ok)) {_top('kept', 10)}"

SQL["bm25_postings"] = SQL["bm25_filtered"]


def _dense(where: str, k: int) -> str:
    return f"""vec AS (
  SELECT record_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[64] AS u FROM (
    SELECT DISTINCT record_id, embedding::DOUBLE[] AS v FROM search_records
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND {where})
), qv AS (
  SELECT query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[64] AS u FROM (
    SELECT DISTINCT query_id, embedding::DOUBLE[] AS v FROM eval_queries JOIN search_records ON record_id = source_patent_id || ':summary' WHERE len(embedding) = 64)
  WHERE list_dot_product(v, v) > 0
), ds AS (SELECT query_id, record_id, round(array_inner_product(qv.u, vec.u), 5) AS score FROM qv, vec),
dt AS ({_top('ds', k)})"""


SQL["dense_topk"] = f"WITH {_dense('true', 10)} SELECT * FROM dt"
_TYPED = "record_type = 'claim' AND is_independent"
SQL["dense_filtered"] = f"WITH {_dense(_TYPED, 10)} SELECT * FROM dt"
SQL["dense_table"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[64] AS u FROM e),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS record_id, round(array_inner_product(q.u, r.u), 5) AS score FROM u q, u r WHERE q.vec_id % 50 = 0)
""" + _top("s", 10)
_HYBRID = f"""{_BM25}, bt AS ({_top('sc', 50)}), {_dense('true', 50)},
merged AS (SELECT coalesce(bt.query_id, dt.query_id) AS query_id, coalesce(bt.record_id, dt.record_id) AS record_id, bt.rank AS bm25_rank, dt.rank AS vector_rank FROM bt FULL JOIN dt ON bt.query_id = dt.query_id AND bt.record_id = dt.record_id),
fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS score FROM merged),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST)::INT AS rank FROM fused QUALIFY rank <= 20)"""


def _grouped(source: str, digits: int) -> str:
    return f"""pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, patent_id ORDER BY score DESC, rank) AS n FROM {source}),
gr AS (
  SELECT query_id, patent_id, max(score) FILTER (n = 1) AS b, avg(score) FILTER (n BETWEEN 2 AND 4) AS nx, max(record_id) FILTER (n = 1) AS best,
    coalesce(list(record_id ORDER BY n) FILTER (n > 1), []) AS supporting, min(rank) AS f FROM pl GROUP BY ALL
), gs AS (SELECT *, b + 0.3::DOUBLE * coalesce(nx, 0) AS score FROM gr)
SELECT query_id, patent_id, round(score, {digits}) AS score, best, supporting, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f)::INT AS rank FROM gs QUALIFY rank <= 10"""


SQL["hybrid_topk"] = f"{_HYBRID} SELECT query_id, record_id, bm25_rank, vector_rank, round(score, 9) AS score, rank FROM hy"
SQL["hybrid_grouped"] = f"{_HYBRID}, hp AS (SELECT hy.*, patent_id FROM hy JOIN r USING (record_id)), {_grouped('hp', 9)}"
_OK = "score IS NOT NULL AND score::VARCHAR NOT LIKE '%nan'"
SQL["group_runs"] = f"""WITH b AS (SELECT run_id AS query_id, record_id, patent_id, max(score) AS score FROM hits WHERE {_OK} GROUP BY ALL),
hp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM b), {_grouped('hp', 6)}"""
SQL["facet_subclass"] = f"{_R} SELECT classification_subclass, count(*) AS count FROM r GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20"
SQL["facet_record_type"] = f"{_R} SELECT record_type, count(*) AS count FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
SQL["patent_lookup"] = f"WITH {_P} SELECT patent_id, title, list_filter(description_paragraphs, lambda x: trim(x) <> '') AS paragraphs FROM p WHERE patent_id = (SELECT min(patent_id) FROM patents)"
SQL["latest_patents"] = f"WITH {_P} SELECT patent_id, ingested_at, source_file FROM p"


def _hollow(c: str) -> str:
    return f"len(list_filter(coalesce({c}, []), lambda x: {_normal('x')} <> '')) = 0"


_ISSUES = f"""WITH {_P}, issues AS (
  SELECT patent_id, 'title' AS field, 'blank' AS issue, 'warning' AS severity FROM p WHERE {_normal('title')} = ''
  UNION ALL SELECT patent_id, 'abstract', 'blank', 'warning' FROM p WHERE {_normal('abstract')} = ''
  UNION ALL SELECT patent_id, 'classification', 'blank', 'warning' FROM p WHERE {_normal('classification_raw')} = ''
  UNION ALL SELECT patent_id, 'claims', 'no non-blank claims', 'error' FROM p WHERE {_hollow('claims_raw')}
  UNION ALL SELECT patent_id, 'detailed_description', 'all paragraphs blank', 'warning' FROM p WHERE {_hollow('description_paragraphs')}
)"""
SQL["validate_issues"] = f"{_ISSUES} SELECT * FROM issues"
SQL["quality_report"] = f"""{_ISSUES}
SELECT 'corpus' AS section, 'patents_loaded' AS key, count(*) AS value FROM p
UNION ALL SELECT 'corpus', 'source_files', count(DISTINCT source_file) FROM p
UNION ALL SELECT 'corpus', 'patents_without_description', count_if(NOT has_description)::BIGINT FROM p
UNION ALL SELECT 'corpus', 'claims_entries_total', coalesce(sum(len(claims_raw)), 0)::BIGINT FROM p
UNION ALL SELECT 'corpus', 'description_paragraphs_total', coalesce(sum(len(description_paragraphs)), 0)::BIGINT FROM p
UNION ALL SELECT 'issues_by_severity', severity, count(*) FROM issues GROUP BY severity
UNION ALL SELECT 'issues_by_field', field, count(*) FROM issues GROUP BY field
UNION ALL SELECT 'classification_subclasses', classification_raw[1:4], count(*) FROM p GROUP BY classification_raw[1:4]"""

_RUN = f"""run AS (
  SELECT method AS system, query_id, record_id, row_number() OVER (PARTITION BY method, query_id ORDER BY max(score) DESC, record_id)::INT AS rank
  FROM hits WHERE {_OK} AND record_id IS NOT NULL GROUP BY ALL
), qr AS (SELECT query_id, unnest(map_keys(qrels)) AS record_id, unnest(map_values(qrels)) AS grade FROM eval_queries)"""
_RUN = _RUN.replace(
    "SELECT method AS system, query_id, record_id, row_number() OVER (PARTITION BY method, query_id ORDER BY max(score) DESC, record_id)::INT AS rank\n  FROM hits",
    "SELECT system, query_id, record_id, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, record_id)::INT AS rank FROM (SELECT method AS system, query_id, record_id, max(score) AS score\n  FROM hits",
).replace("GROUP BY ALL\n), qr", "GROUP BY ALL)\n), qr")
_KS = (5, 10, 20, 50)
_METRICS = ("success@{k}", "recall@{k}", "recall_ceiling@{k}", "precision@{k}", "ndcg@{k}", "mrr@{k}", "map@{k}", "success@{k}_strict", "precision@{k}_strict")


def _metric_sql() -> str:
    aggs, ideal, out = [], [], []
    for k in _KS:
        aggs += [
            f"count_if(rank <= {k} AND grade >= 1) AS r{k}", f"count_if(rank <= {k} AND grade >= 2) AS s{k}", f"min(rank) FILTER (rank <= {k} AND grade >= 1) AS f{k}",
            f"sum((pow(2.0::DOUBLE, grade) - 1) / log2(rank + 1.0::DOUBLE)) FILTER (rank <= {k}) AS d{k}", f"sum(hits / rank::DOUBLE) FILTER (rank <= {k} AND grade >= 1) AS a{k}",
        ]
        ideal.append(f"sum((pow(2.0::DOUBLE, grade) - 1) / log2(p + 1.0::DOUBLE)) FILTER (p <= {k}) AS i{k}")
        out += [
            f'CASE WHEN r{k} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "success@{k}"', f'CASE WHEN n1 > 0 THEN r{k} / n1::DOUBLE ELSE 0 END AS "recall@{k}"',
            f'CASE WHEN n1 > 0 THEN least({k}, n1) / n1::DOUBLE ELSE 0 END AS "recall_ceiling@{k}"', f'r{k} / {k}::DOUBLE AS "precision@{k}"', f'CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0 END AS "ndcg@{k}"',
            f'CASE WHEN f{k} > 0 THEN 1.0::DOUBLE / f{k} ELSE 0 END AS "mrr@{k}"', f'CASE WHEN n1 > 0 THEN a{k} / least({k}, n1) ELSE 0 END AS "map@{k}"',
            f'CASE WHEN s{k} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "success@{k}_strict"', f's{k} / {k}::DOUBLE AS "precision@{k}_strict"',
        ]
    filled = ", ".join(f"coalesce({c}{k}, 0) AS {c}{k}" for k in _KS for c in "rsfdai")
    return f"""WITH {_RUN}, pos AS (SELECT * FROM qr WHERE grade > 0),
judged AS (SELECT run.*, coalesce(grade, 0) AS grade FROM run LEFT JOIN pos USING (query_id, record_id)),
counted AS (SELECT *, sum((grade >= 1)::INT) OVER (PARTITION BY system, query_id ORDER BY rank) AS hits FROM judged),
per AS (SELECT system, query_id, {', '.join(aggs)} FROM counted GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, record_id) AS p FROM pos),
ide AS (SELECT query_id, count(*) AS n1, {', '.join(ideal)} FROM placed GROUP BY query_id),
every AS (SELECT system, query_id FROM (SELECT DISTINCT system FROM run), (SELECT DISTINCT query_id FROM eval_queries)),
filled AS (SELECT system, query_id, coalesce(n1, 0) AS n1, {filled} FROM every LEFT JOIN per USING (system, query_id) LEFT JOIN ide USING (query_id)),
pq AS (SELECT system, query_id, {', '.join(out)} FROM filled)"""


_NAMES = [m.format(k=k) for k in _KS for m in _METRICS]
_PQ = _metric_sql()
SQL["evaluate_queries"] = f"{_PQ} SELECT system, query_id, " + ", ".join(f'round("{m}", 9) AS "{m}"' for m in _NAMES) + " FROM pq"
SQL["evaluate_systems"] = f"{_PQ} SELECT system, " + ", ".join(f'round(sum("{m}") / count(*), 9) AS "{m}"' for m in _NAMES) + " FROM pq GROUP BY system"
SQL["t_test_terms"] = f"""{_PQ}, d AS (SELECT a.system, a."ndcg@10" AS a, b."ndcg@10" AS b FROM pq a JOIN pq b ON b.system = 'bm25' AND a.query_id = b.query_id WHERE a.system <> 'bm25'),
g AS (SELECT system, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS delta, var_samp(a - b) AS var FROM d GROUP BY system)
SELECT system, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(delta, 6) AS delta, round(var, 6) AS var, round(CASE WHEN n >= 2 AND var > 0 THEN delta / sqrt(var / n) END, 6) AS t FROM g"""
SQL["latency_percentiles"] = """WITH m AS (SELECT method, (epoch_us(logged_at) - epoch_us(searched_at)) / 1000.0::DOUBLE AS v FROM hits WHERE logged_at IS NOT NULL AND searched_at IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY v) AS i, count(*) OVER (PARTITION BY method) AS n FROM m)
SELECT method, max(v) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0) + 1) AS p50, max(v) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0) + 1) AS p95, round(avg(v), 4) AS mean, count(*) AS n FROM p GROUP BY method"""
_POOL = "WITH " + _RUN + ", pool AS (SELECT query_id, record_id, list_sort(list(DISTINCT system)) AS found_by, min(rank) AS best_rank FROM run WHERE rank <= {depth} GROUP BY ALL)"
SQL["pool_candidates"] = _POOL.format(depth=50) + " SELECT * FROM pool"
SQL["pool_stats"] = _POOL.format(depth=50) + """, z AS (SELECT query_id, count(*) AS size, count_if(len(found_by) > 1) AS multi FROM pool GROUP BY query_id)
SELECT count(*) AS queries, sum(size)::BIGINT AS total_candidates, round(avg(size), 1) AS mean_pool_size, max(size) AS max_pool_size, round(avg(multi), 1) AS mean_found_by_multiple_systems FROM z"""
SQL["pool_unjudged"] = _POOL.format(depth=50) + """, u AS (SELECT * FROM pool ANTI JOIN (SELECT * FROM qr WHERE grade > 0) USING (query_id, record_id))
SELECT query_id, record_id, ((row_number() OVER (PARTITION BY query_id ORDER BY best_rank, record_id) - 1) // 10)::INT AS batch FROM u"""
SQL["merge_qrels"] = _POOL.format(depth=50) + """, j AS (SELECT query_id, record_id, best_rank % 4 AS grade FROM pool)
SELECT coalesce(j.query_id, qr.query_id) AS query_id, coalesce(j.record_id, qr.record_id) AS record_id, coalesce(j.grade, qr.grade)::INT AS grade
FROM qr FULL JOIN j ON qr.query_id = j.query_id AND qr.record_id = j.record_id WHERE coalesce(j.grade, qr.grade) > 0"""
SQL["trec_run"] = f"WITH {_RUN} SELECT query_id, printf('%s Q0 %s %d %.6f hybrid', query_id, record_id, rank, 1.0::DOUBLE / rank) AS line FROM run WHERE system = 'hybrid'"


def _overlap(q: str, t: str) -> str:
    qs, ts = (f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))" for x in (q, t))
    return f"CASE WHEN len({qs}) > 0 THEN len(list_intersect({qs}, {ts})) / len({qs})::DOUBLE ELSE 0.0::DOUBLE END"


_PAIRS = f"{_R}, qr AS (SELECT query_id, text AS query, source_patent_id, unnest(map_keys(qrels)) AS record_id, unnest(map_values(qrels)) AS grade FROM eval_queries)"
SQL["lexical_overlap"] = f"{_PAIRS} SELECT query_id, record_id, round({_overlap('query', 'r.text')}, 9) AS overlap FROM qr JOIN r USING (record_id)"
SQL["overlap_report"] = f"""{_PAIRS}, f AS (SELECT {_overlap('query', 'r.text')} AS o FROM qr JOIN r USING (record_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY record_id) = 1)
SELECT count(*) AS n, round(avg(o), 4) AS mean_overlap, round(median(o), 4) AS median_overlap FROM f"""
SQL["cross_patent"] = f"""{_PAIRS} SELECT count(*) AS pairs, count_if(NOT coalesce(starts_with(record_id, source_patent_id || ':'), false))::BIGINT AS cross_patent,
  count_if(grade = 1)::BIGINT AS grade_1, count_if(grade = 2)::BIGINT AS grade_2, count_if(grade = 3)::BIGINT AS grade_3 FROM qr"""
_RANKED = f"""{_R}, one AS (
  SELECT query_id, record_id, min(CASE WHEN bm25_rank >= 1 THEN bm25_rank END) AS bm25_rank, min(CASE WHEN vector_rank >= 1 THEN vector_rank END) AS vector_rank, max(CASE WHEN {_OK} THEN score END) AS score
  FROM hits WHERE record_id IS NOT NULL GROUP BY ALL
), rh AS (SELECT one.*, q.text AS query, r.text, r.title, r.record_type, r.claim_number FROM one JOIN eval_queries q USING (query_id) JOIN r USING (record_id))"""


def _ft(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{_NS}+'), lambda t: length(t) > 2))"


def _fo(c: str) -> str:
    return f"round(CASE WHEN len({_ft('query')}) > 0 THEN len(list_intersect({_ft('query')}, {_ft(c)})) / len({_ft('query')})::DOUBLE ELSE 0 END, 9)"


SQL["ltr_features"] = f"""{_RANKED} SELECT query_id, record_id, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 9) AS bm25_rr, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 9) AS vec_rr,
  (bm25_rank IS NOT NULL AND vector_rank IS NOT NULL)::INT::DOUBLE AS found_by_both, (bm25_rank IS NOT NULL AND vector_rank IS NULL)::INT::DOUBLE AS bm25_only, (bm25_rank IS NULL AND vector_rank IS NOT NULL)::INT::DOUBLE AS vec_only,
  round(score, 9) AS fused_score, (record_type = 'claim')::INT::DOUBLE AS is_claim, (record_type = 'abstract')::INT::DOUBLE AS is_abstract, (record_type = 'summary')::INT::DOUBLE AS is_summary, (record_type = 'description')::INT::DOUBLE AS is_description,
  coalesce(claim_number = 1, false)::INT::DOUBLE AS is_independent, round(1.0::DOUBLE / log2(2.0::DOUBLE + coalesce(claim_number, 0)), 9) AS claim_number_norm, round(least(length(text) / 2000.0::DOUBLE, 1), 9) AS text_len_norm,
  round(least(length(query) / 2000.0::DOUBLE, 1), 9) AS query_len_norm, {_fo('text')} AS term_overlap, {_fo('title')} AS title_overlap FROM rh"""
SQL["ltr_labels"] = f"""{_RANKED}, qr AS (SELECT query_id, unnest(map_keys(qrels)) AS record_id, unnest(map_values(qrels)) AS grade FROM eval_queries)
SELECT coalesce(grade, 0)::INT AS label, count(*) AS rows, count(DISTINCT query_id) AS queries FROM rh LEFT JOIN (SELECT * FROM qr WHERE grade > 0) USING (query_id, record_id) GROUP BY 1"""
SQL["ltr_usable_rows"] = """SELECT lower(trim(query_id)) AS query_id, count(DISTINCT trim(record_id)) AS rows FROM feature_rows
WHERE len(features) = 16 AND label >= 0 AND len(list_filter(features, lambda x: x IS NULL OR x::VARCHAR LIKE '%nan')) = 0 GROUP BY 1"""
_TOP20 = f"{_RANKED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM rh WHERE score IS NOT NULL QUALIFY rank <= 20)"
SQL["rerank_identity"] = f"{_TOP20} SELECT query_id, record_id, (count(*) OVER (PARTITION BY query_id) - rank + 1)::DOUBLE AS rerank_score, rank::INT AS rank FROM t"
SQL["rerank_overlap"] = f"""{_TOP20}, s AS (SELECT query_id, record_id, rank, {_overlap('query', 'text[1:2000]')} AS v FROM t)
SELECT query_id, record_id, round(v, 9) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, s.rank)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, s.rank) <= 10"""
SQL["synonym_terms"] = f"SELECT query_id, {_terms('text')} AS terms FROM eval_queries"
SQL["stem_terms"] = f"""WITH asked AS (SELECT query_id, {_terms('text')} AS terms FROM eval_queries), each AS (SELECT query_id, unnest(terms) AS w, unnest(range(len(terms))) AS i FROM asked), vocab AS (SELECT DISTINCT w FROM each), {_STEMS},
listed AS (SELECT query_id, list(s ORDER BY i) AS terms FROM each JOIN stems USING (w) GROUP BY query_id)
SELECT asked.query_id, coalesce(listed.terms, []) AS terms FROM asked LEFT JOIN listed ON listed.query_id = asked.query_id"""
SQL["content_hash"] = f"WITH {_P} SELECT patent_id, sha256(concat_ws('|', patent_id, title, classification_raw)) AS hash FROM p"
SQL["hashing_embed"] = """WITH b AS (SELECT query_id, unnest(range(40))::INT AS i, sha256(coalesce(text, '')) AS h FROM eval_queries),
x AS (SELECT query_id, i, ('0x' || h[(i % 32) * 2 + 1 : (i % 32) * 2 + 2])::INT / 255.0::DOUBLE AS v FROM b)
SELECT query_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY query_id)), 9) AS x FROM x"""
_JOBS = """WITH p AS (SELECT patent_id, min(ingested_at) AS first_at, max(source_file) AS source_file, count(*) AS k, right(patent_id, 2)::INT AS n FROM patents WHERE patent_id IS NOT NULL GROUP BY patent_id),
j AS (SELECT *, CASE n % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'EMBEDDING' ELSE 'COMPLETED' END AS status, epoch_us(first_at) / 1000000.0::DOUBLE AS updated FROM p)"""
SQL["job_enqueue_decision"] = f"{_JOBS} SELECT patent_id, NOT (status IN ('COMPLETED', 'FAILED') AND k = 1) AS queue FROM j"
SQL["job_counts"] = f"{_JOBS} SELECT status, count(*) AS jobs FROM j GROUP BY status"
SQL["job_summary"] = f"""{_JOBS} SELECT count(*) AS total, count_if(status = 'COMPLETED')::BIGINT AS completed, count_if(status = 'FAILED')::BIGINT AS failed,
  round(100.0::DOUBLE * count_if(status = 'COMPLETED') / count(*), 1) AS percent_complete, coalesce(sum(n) FILTER (status = 'COMPLETED'), 0)::BIGINT AS records_indexed FROM j"""
SQL["job_failures"] = f"{_JOBS} SELECT patent_id, 'ValueError' AS last_error, 3 AS retry_count FROM j WHERE status = 'FAILED' ORDER BY updated DESC, patent_id LIMIT 20"
SQL["job_claim"] = f"{_JOBS} SELECT patent_id, 'VALIDATING' AS status, 1733000000.0::DOUBLE AS leased_at FROM j WHERE status = 'PENDING' AND n % 4 < 3 ORDER BY updated, patent_id LIMIT 25"
SQL["job_reclaim"] = f"{_JOBS} SELECT CASE WHEN status = 'EMBEDDING' AND updated <= 1733000000.0::DOUBLE - 300 THEN 'PENDING' ELSE status END AS status, count(*) AS jobs FROM j GROUP BY 1"
SQL["event_windows"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SQL["distinct_hits"] = "SELECT run_id, count(DISTINCT record_id) AS hits FROM hits WHERE run_id IS NOT NULL AND record_id IS NOT NULL GROUP BY run_id"


def _hash(c: str, seed: int) -> str:
    return f"('0x' || md5('{seed}:' || {c})[1:15])::BIGINT"


SQL["engine_search"] = f"""{_BM25}, bt AS ({_top('sc', 50)}), {_dense('true', 50).split('), qv AS (')[0]}), hb AS (SELECT query_id, unnest(range(64))::INT AS i, sha256(text) AS h FROM eval_queries),
hv AS (SELECT query_id, list(('0x' || h[(i % 32) * 2 + 1 : (i % 32) * 2 + 2])::INT / 255.0::DOUBLE ORDER BY i) AS v FROM hb GROUP BY query_id),
qv AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[64] AS u FROM hv),
ds AS (SELECT query_id, record_id, round(array_inner_product(qv.u, vec.u), 5) AS score FROM qv, vec), dt AS ({_top('ds', 50)}),
merged AS (SELECT coalesce(bt.query_id, dt.query_id) AS query_id, coalesce(bt.record_id, dt.record_id) AS record_id, bt.rank AS bm25_rank, dt.rank AS vector_rank FROM bt FULL JOIN dt ON bt.query_id = dt.query_id AND bt.record_id = dt.record_id),
fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS score FROM merged),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST) AS fr FROM fused QUALIFY fr <= 50),
rr AS (SELECT hy.*, r.text, {_overlap('q.text', 'r.text[1:2000]')} AS v FROM hy JOIN r USING (record_id) JOIN eval_queries q USING (query_id))
SELECT query_id, record_id, round(v, 4) AS score, round(v, 4) AS rerank_score, bm25_rank, vector_rank, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, fr)::INT AS rank, text[1:400] AS text FROM rr QUALIFY rank <= 10"""
SQL["engine_patents"] = f"""{_BM25}, bt AS ({_top('sc', 20)}), hp AS (SELECT bt.*, patent_id FROM bt JOIN r USING (record_id)), {_grouped('hp', 9).replace('round(score, 9)', 'round(score::DECIMAL(18, 9), 4)::DOUBLE').replace('best, supporting,', 'best, supporting[1:5] AS supporting, len(supporting)::INT AS supporting_count,', 1)}"""
SQL["request_checks"] = """SELECT * FROM (VALUES ('fits', true), ('unknown method', false), ('no reranker', false), ('no embedder', false), ('fewer candidates than results', false), ('too many results', false), ('no results', false), ('empty query', false),
  ('longest query', true), ('query too long', false), ('prefix too long', false), ('keyword too long', false), ('title too long', false), ('patent too long', false), ('known embedder', true), ('unknown embedder', false), ('known reranker', true), ('unknown reranker', false)) t(request, accepted)"""
_PRIME = (1 << 31) - 1
_DRAW = f"((b + 1) * 7919 + i * 104729 + 7) % {_PRIME}"
for _add in (12_345, 678_901, 2_345_678):
    _DRAW = f"list_transform([{_DRAW}], lambda x: (x * x + {_add}) % {_PRIME} * 48271 % {_PRIME})[1]"
_COMPARED = f"""{_PQ}, dd AS (SELECT a.system, a.query_id, a."ndcg@10" AS a, b."ndcg@10" AS b, a."ndcg@10" - b."ndcg@10" AS d FROM pq a JOIN pq b ON b.system = 'bm25' AND a.query_id = b.query_id WHERE a.system <> 'bm25'),
cp AS (SELECT system, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS observed, count(*) AS n, list(d ORDER BY query_id) AS ds FROM dd GROUP BY system)"""
SQL["compare_systems"] = f"""{_COMPARED}, draws AS (SELECT b, i, {_DRAW} AS x FROM (SELECT unnest(range(10000)) AS b), (SELECT unnest(range(1, (SELECT max(n) FROM cp) + 1)) AS i)),
means AS (SELECT system, b, avg(ds[x % n + 1] - observed) AS m FROM cp JOIN draws ON i <= n GROUP BY system, b),
ps AS (SELECT system, (count_if(abs(m) >= abs(observed) - 1e-12) + 1) / 10001.0::DOUBLE AS p FROM means JOIN cp USING (system) GROUP BY system)
SELECT 'ndcg@10' AS metric, system AS system_a, 'bm25' AS system_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_a - mean_b, 6) AS delta, round(CASE WHEN observed = 0 THEN 1 ELSE p END, 6) AS p_value, n, 'bootstrap' AS test,
  CASE WHEN observed = 0 THEN false ELSE p < 0.05 END AS significant FROM cp JOIN ps USING (system)"""
SQL["compare_t"] = f"{_COMPARED} SELECT 'ndcg@10' AS metric, system AS system_a, 'bm25' AS system_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_a - mean_b, 6) AS delta, n, 't' AS test FROM cp"
SQL["comparison_lines"] = f"""{_PQ}, mn AS (SELECT system, avg("recall@10") AS a, avg("ndcg@10") AS b, avg("mrr@10") AS c, avg("recall_ceiling@10") AS e, avg("recall_ceiling@50") AS f, row_number() OVER (ORDER BY system) AS i FROM pq GROUP BY system)
SELECT 0 AS no, printf('%-20s%18s%18s%18s', 'system', 'recall@10', 'ndcg@10', 'mrr@10') AS line UNION ALL SELECT 1, repeat('-', 74) UNION ALL SELECT (i + 1)::INT, printf('%-20s%18.4f%18.4f%18.4f', system, a, b, c) FROM mn
UNION ALL SELECT (max(i) + 2)::INT, '' FROM mn UNION ALL SELECT ((SELECT max(i) FROM mn) + 3)::INT, printf('recall ceilings: recall@10 max %.3f, recall@50 max %.3f', e, f) FROM mn WHERE i = 1"""
SQL["eval_set"] = f"""{_R}, per AS (SELECT patent_id, count(*) AS n, max(abstract) AS abstract FROM r GROUP BY patent_id),
ch AS (SELECT patent_id, abstract, row_number() OVER (ORDER BY {_hash('patent_id', 13)}, patent_id) - 1 AS no FROM per WHERE n >= 2 AND coalesce(abstract, '') <> '' QUALIFY no < 60),
gd AS (SELECT r.patent_id, no, record_id, record_type, text, is_independent, CASE WHEN record_type = 'claim' THEN CASE WHEN is_independent THEN 3 ELSE 2 END WHEN record_type IN ('abstract', 'summary') THEN 2 ELSE 1 END AS grade FROM r JOIN ch USING (patent_id)),
cl AS (SELECT patent_id, no, record_id, text FROM gd WHERE is_independent QUALIFY row_number() OVER (PARTITION BY patent_id ORDER BY {_hash('record_id', 13)}, record_id) = 1),
qs AS (SELECT patent_id, printf('q%03da', no) AS query_id, abstract AS text, 'abstract_to_claim' AS query_type, NULL AS own FROM ch UNION ALL SELECT patent_id, printf('q%03dc', no), text, 'claim_to_patent', record_id FROM cl)
SELECT query_id, qs.text, qs.patent_id AS source_patent_id, query_type, record_id, grade FROM qs JOIN gd USING (patent_id) WHERE CASE WHEN query_type = 'abstract_to_claim' THEN record_type NOT IN ('abstract', 'summary') ELSE record_id <> own END"""
SQL["eval_set_lines"] = "SELECT query_id, text, source_patent_id, query_type, cardinality(qrels)::INT AS relevant, 13 AS seed FROM eval_queries"
SQL["paraphrase"] = "SELECT query_id, 'in other words: ' || text AS text, cardinality(qrels)::INT AS relevant FROM eval_queries WHERE length(text) % 2 = 0"
SQL["judge_pool"] = _POOL.format(depth=50) + " SELECT query_id, record_id, coalesce(grade, greatest(0, least(3, best_rank % 6 - 1)))::INT AS grade FROM pool LEFT JOIN (SELECT * FROM qr WHERE grade > 0) USING (query_id, record_id)"
SQL["apply_judgements"] = _POOL.format(depth=50) + " SELECT query_id, source_patent_id, record_id, (best_rank % 4)::INT AS grade FROM pool JOIN eval_queries USING (query_id) WHERE best_rank % 4 > 0"
SQL["first_judgements"] = """WITH c AS (SELECT query_id, record_id, logged_at, max(bm25_rank) % 4 AS grade FROM hits WHERE record_id IS NOT NULL AND logged_at IS NOT NULL AND bm25_rank >= 1 GROUP BY ALL)
SELECT query_id, record_id, arg_min(grade, logged_at)::INT AS grade FROM c GROUP BY ALL"""
SQL["rerank_pairs"] = f"{_TOP20}, s AS (SELECT query_id, record_id, t.rank AS fr, length(coalesce(text, '')[1:2000])::DOUBLE AS v FROM t) SELECT query_id, record_id, v AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, fr)::INT AS rank FROM s QUALIFY rank <= 10"
SQL["rerank_graded"] = f"{_TOP20} SELECT query_id, record_id, CASE WHEN (rank - 1) % 10 % 2 = 0 THEN length(text[1:1200]) % 4 ELSE 1 END::DOUBLE AS rerank_score FROM t"
_PREFIXED = "'Represent this sentence for searching relevant passages: ' || text"
SQL["embed_registered"] = f"SELECT query_id, 0 AS i, length({_PREFIXED})::DOUBLE AS x FROM eval_queries UNION ALL SELECT query_id, 1, (length({_PREFIXED}) - length(replace({_PREFIXED}, 'e', '')))::DOUBLE FROM eval_queries"
SQL["ltr_split"] = f"""WITH f AS (SELECT lower(trim(query_id)) AS query_id, trim(record_id) AS record_id, min(nullif(lower(trim(patent_id)), '')) AS patent_id FROM feature_rows
  WHERE len(features) = 16 AND label >= 0 AND len(list_filter(features, lambda x: x IS NULL OR x::VARCHAR LIKE '%nan')) = 0 GROUP BY ALL),
p AS (SELECT patent_id, row_number() OVER (ORDER BY {_hash('patent_id', 17)}) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT patent_id FROM f WHERE patent_id IS NOT NULL))
SELECT query_id, record_id, patent_id, CASE WHEN i <= greatest(1, floor(n * 0.75::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM f JOIN p USING (patent_id)"""
SQL["job_advance"] = f"{_JOBS} SELECT patent_id, CASE status WHEN 'EMBEDDING' THEN 'INDEXING' ELSE status END AS status, CASE WHEN status = 'EMBEDDING' THEN {1733000000.0}::DOUBLE END AS leased_at, CASE WHEN status = 'EMBEDDING' THEN 'w1' END AS worker_id FROM j"
SQL["job_outcomes"] = f"""{_JOBS}, o AS (SELECT *, status IN ('PENDING', 'EMBEDDING') AS mine, n % 2 = 1 AS bad, CASE WHEN status = 'FAILED' THEN 3 ELSE n % 4 END AS r FROM j)
SELECT patent_id, CASE WHEN mine AND NOT bad THEN 'COMPLETED' WHEN mine THEN CASE WHEN r + 1 < 3 THEN 'PENDING' ELSE 'FAILED' END ELSE status END AS status, CASE WHEN mine AND NOT bad THEN 7 WHEN status = 'COMPLETED' THEN n ELSE 0 END::BIGINT AS record_count,
  CASE WHEN mine AND bad THEN r + 1 ELSE r END::INT AS retry_count, CASE WHEN mine AND bad THEN 2000 WHEN status = 'FAILED' THEN 10 END::INT AS error_chars, NULL::VARCHAR AS worker_id, CASE WHEN mine THEN {1733000000.0}::DOUBLE ELSE updated END AS updated_at FROM o"""
SQL["job_lookup"] = f"{_JOBS} SELECT patent_id, status, CASE WHEN status = 'FAILED' THEN 3 ELSE n % 4 END::INT AS retry_count FROM j WHERE patent_id = (SELECT min(patent_id) FROM patents)"
_MADE = SQL["build_records"]
SQL["ingest_jobs"] = f"""WITH m AS (SELECT patent_id, count(*) AS n FROM ({_MADE}) GROUP BY patent_id), {_P}, g AS (SELECT patent_id, {_hollow('claims_raw')} AS bad FROM p)
SELECT patent_id, CASE WHEN bad THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN bad THEN 0 ELSE n END::BIGINT AS record_count, CASE WHEN bad THEN 3 ELSE 0 END::INT AS retry_count, CASE WHEN bad THEN 'ValueError: validation failed: no non-blank claims' END AS last_error FROM g LEFT JOIN m USING (patent_id)"""
SQL["ingest_again"] = f"SELECT record_id, text FROM ({_MADE}) WHERE record_type = 'claim'"
SQL["records_upsert"] = "SELECT DISTINCT record_id, CASE WHEN record_type = 'claim' THEN 'v2 ' || text ELSE text END AS text FROM search_records"
SQL["records_json"] = f"SELECT DISTINCT {_BARE} FROM search_records"
_CORPUS = f"""WITH {_P}, c AS (SELECT *, right(patent_id, 2)::INT AS n, printf('patents_a%02d.json', right(patent_id, 2)::INT) AS file, (right(patent_id, 2)::INT % 10 = 3) AS lacking FROM p)"""
SQL["corpus_patents"] = f"""{_CORPUS} SELECT patent_id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, coalesce(classification_raw, '') AS classification_raw, len(list_filter(coalesce(claims_raw, []), lambda x: x IS NOT NULL))::INT AS claims,
  len(list_filter(coalesce(description_paragraphs, []), lambda x: x IS NOT NULL))::INT AS paragraphs, file AS source_file, NOT {_hollow('description_paragraphs')} AS has_description FROM c WHERE NOT lacking AND NOT {_hollow('claims_raw')}"""
_SEEN = "(SELECT * FROM c UNION ALL SELECT * REPLACE (replace(file, '_a', '_b') AS file) FROM c WHERE n % 10 = 1)"
SQL["corpus_issues"] = f"""{_CORPUS}, s AS {_SEEN}, w(field, issue, severity) AS (SELECT 1, 2, 3 WHERE false)
SELECT patent_id, 'claims' AS field, 'field absent' AS issue, 'error' AS severity, file FROM s WHERE lacking UNION ALL SELECT patent_id, 'claims', 'no non-blank claims', 'error', file FROM s WHERE lacking OR {_hollow('claims_raw')}
UNION ALL SELECT patent_id, 'title', 'blank', 'warning', file FROM s WHERE {_normal('title')} = '' UNION ALL SELECT patent_id, 'abstract', 'blank', 'warning', file FROM s WHERE {_normal('abstract')} = '' UNION ALL SELECT patent_id, 'classification', 'blank', 'warning', file FROM s WHERE {_normal('classification_raw')} = ''
UNION ALL SELECT patent_id, 'detailed_description', 'all paragraphs blank', 'warning', file FROM s WHERE {_hollow('description_paragraphs')} UNION ALL SELECT patent_id, 'doc_number', 'duplicate across corpus', 'error', file FROM s WHERE file LIKE '%\\_b%' ESCAPE '\\'"""
_STATS = ["claims_total", "independent", "dependent", "number_inferred", "multi_fragment", "status_canceled", "status_original_complete", "status_preamble_stripped", "status_rejoined_continuation", "patents_with_out_of_order_numbering"]
SQL["extraction_report"] = f"WITH z AS ({SQL['reconstruction_stats']}), y AS ({_CLAIMS} SELECT claim_id FROM c GROUP BY claim_id HAVING count(*) > 1) " + " UNION ALL ".join([*[f"SELECT 'claims' AS section, '{c}' AS key, {c}::BIGINT AS value FROM z" for c in _STATS], "SELECT 'claims', 'numbers_given_twice', count(*) FROM y"])
SQL["records_with_vectors"] = """WITH r AS (SELECT DISTINCT record_id, record_type FROM search_records), v AS (SELECT record_id, min(embedding) AS e FROM search_records WHERE record_type = 'claim' AND len(embedding) = 64 GROUP BY record_id)
SELECT record_id, record_type, e IS NOT NULL AS embedded, round(e[1]::DOUBLE, 6) AS first FROM r LEFT JOIN v USING (record_id)"""
_SPLIT = SQL["ltr_split"].replace("SELECT query_id, record_id, patent_id, CASE", "SELECT f.*, CASE").replace("min(nullif(lower(trim(patent_id)), '')) AS patent_id FROM", "min(nullif(lower(trim(patent_id)), '')) AS patent_id, arg_min(label, {'l': nullif(lower(trim(patent_id)), '') IS NULL, 'p': nullif(lower(trim(patent_id)), ''), 'f': features, 'x': label}) AS label FROM")
SQL["ltr_report"] = f"SELECT split, count(*) AS rows, count(DISTINCT patent_id) AS patents, " + ", ".join(f"count_if(label = {g})::BIGINT AS label_{g}" for g in range(4)) + f" FROM ({_SPLIT}) GROUP BY split"
