"""Common table expressions that the SQL forms of the queries share."""

from siftwell.functions.text import TOKEN

T = TOKEN.replace("'", "''")


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{T}'), lambda x_: replace(lower(x_), 'ß', 'ss'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x_: x_ <> '')"


CHUNKS = rf"""
docs AS (SELECT doc_id::VARCHAR AS document_id, source, lang, text FROM documents),
w AS (SELECT document_id, source, {words("text")} AS ws FROM docs),
nw AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 220 THEN 1 ELSE 1 + ceil((len(ws) - 220) / 180.0)::BIGINT END AS k FROM w),
cut AS (SELECT document_id, source, ws, unnest(range(k)) AS ordinal FROM nw),
chunk0 AS (SELECT document_id, source AS heading, ordinal::INT AS ordinal, source || chr(10) || array_to_string(ws[ordinal * 180 + 1 : ordinal * 180 + 220], ' ') AS text FROM cut),
chunks AS (SELECT *, document_id || '::' || lpad(ordinal::VARCHAR, 4, '0') || '::' || substr(sha256(text), 1, 12) AS chunk_id FROM chunk0)
"""
TOKENS = CHUNKS + f""",
tk AS (SELECT chunk_id, document_id, {tok("text")} AS toks FROM chunks),
tl AS (SELECT *, len(toks) AS len FROM tk),
post AS (SELECT chunk_id, document_id, len, term, count(*) AS tf FROM (SELECT chunk_id, document_id, len, unnest(toks) AS term FROM tl) GROUP BY ALL)
"""
CASES = f"""
,qs AS (SELECT item_id AS case_id, text AS question, {tok("text")} AS qt, CASE WHEN item_id % 3 = 2 THEN 'test' ELSE 'dev' END AS split FROM benchmark WHERE text IS NOT NULL),
dt AS (SELECT document_id, lang, ' ' || array_to_string({tok("text")}, ' ') || ' ' AS body FROM docs),
rel AS (SELECT case_id, document_id, lang FROM qs JOIN dt ON contains(body, ' ' || array_to_string(qt, ' ') || ' ') WHERE len(qt) > 0),
cases AS (SELECT qs.*, r.m IS NOT NULL AS answerable, coalesce(r.lang, 'en') AS language, coalesce(r.n, 0) AS n_relevant
  FROM qs LEFT JOIN (SELECT case_id, count(*) AS n, min(document_id::BIGINT) AS m, arg_min(lang, document_id::BIGINT) AS lang FROM rel GROUP BY case_id) r USING (case_id))
"""
BM25 = """
,st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM tl),
qterm AS (SELECT case_id, term, count(*) AS qtf FROM (SELECT case_id, unnest(qt) AS term FROM qs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM dfs, st),
bs AS (SELECT case_id, chunk_id, document_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 9) AS score
  FROM qterm JOIN idf USING (term) JOIN post USING (term), st GROUP BY ALL),
bd0 AS (SELECT case_id, document_id, score, chunk_id AS best_chunk_id, row_number() OVER (PARTITION BY case_id, document_id ORDER BY score DESC, chunk_id) AS r FROM bs),
bd AS (SELECT * FROM (SELECT case_id, document_id, score, best_chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, document_id) AS rank FROM bd0 WHERE r = 1) WHERE rank <= 10)
"""
DENSE = """
,cb AS (SELECT chunk_id, document_id, bucket, sum(tf)::DOUBLE AS tf FROM (SELECT chunk_id, document_id, tf, ('0x' || substr(md5(term), 1, 4))::INT % 256 AS bucket FROM post) GROUP BY ALL),
cv AS (SELECT chunk_id, document_id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY chunk_id)) AS w FROM cb),
qb AS (SELECT case_id, bucket, sum(qtf)::DOUBLE AS tf FROM (SELECT case_id, qtf, ('0x' || substr(md5(term), 1, 4))::INT % 256 AS bucket FROM qterm) GROUP BY ALL),
qv AS (SELECT case_id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY case_id)) AS qw FROM qb),
ds AS (SELECT case_id, chunk_id, document_id, round(sum(w * qw), 9) AS score FROM cv JOIN qv USING (bucket) GROUP BY ALL),
dc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS rank FROM ds) WHERE rank <= 100),
dd0 AS (SELECT case_id, document_id, score, chunk_id AS best_chunk_id, row_number() OVER (PARTITION BY case_id, document_id ORDER BY score DESC, chunk_id) AS r FROM dc),
dd AS (SELECT * FROM (SELECT case_id, document_id, score, best_chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, document_id) AS rank FROM dd0 WHERE r = 1) WHERE rank <= 10)
"""
RANKS = """
,both_ AS (SELECT case_id, document_id, rank, 'bm25' AS source, 1.0::DOUBLE AS weight FROM bd UNION ALL SELECT case_id, document_id, rank, 'dense', 1.0::DOUBLE FROM dd)
"""
HYBRID = RANKS + """
,hs AS (SELECT case_id, document_id, round(sum(weight / (60 + rank)), 9) AS score FROM both_ GROUP BY ALL),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, document_id) AS rank FROM hs) WHERE rank <= 10)
"""
KS = (1, 3, 5, 10)


def metrics(name: str, ranked: str, by: str = "case_id") -> str:
    """CTE ``name``: case metrics of the CTE ``ranked``, for the columns ``by``."""
    extra = "" if by == "case_id" else ", " + by.replace("case_id, ", "")
    parts = [f"count(*) FILTER (WHERE hit AND rank <= {k}) / any_value(n)::DOUBLE AS r{k}, count(*) FILTER (WHERE hit AND rank <= {k}) / {k}.0::DOUBLE AS p{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit AND rank <= {k}), 0.0::DOUBLE) AS d{k}" for k in KS]
    cols = [f"round(r{k}, 6) AS recall_at_{k}, round(p{k}, 6) AS precision_at_{k}, round(d{k} / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg_at_{k}" for k in KS]
    return f"""
,{name}n AS (SELECT case_id, count(DISTINCT document_id) AS n FROM rel GROUP BY case_id),
{name}h AS (SELECT x.*, e.document_id IS NOT NULL AS hit, n FROM {ranked} x JOIN {name}n USING (case_id) LEFT JOIN (SELECT DISTINCT case_id, document_id FROM rel) e ON e.case_id = x.case_id AND e.document_id = x.document_id),
{name}a AS (SELECT {by}, any_value(n) AS n, {", ".join(parts)}, min(rank) FILTER (WHERE hit AND rank <= 10) AS first FROM {name}h GROUP BY {by}),
{name} AS (SELECT case_id{extra}, {", ".join(cols)}, round(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE), 6) AS mrr_at_10 FROM {name}a)
"""


METRICS = [f"{m}_at_{k}" for k in KS for m in ("recall", "precision", "ndcg")] + ["mrr_at_10"]


def summary(name: str, source: str, columns=METRICS) -> str:
    """CTE ``name``: grouped means of ``source`` joined with cases."""
    means = ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in columns)
    return f"""
,{name} AS (SELECT CASE WHEN split IS NOT NULL THEN split WHEN language IS NOT NULL THEN 'language:' || language ELSE 'all' END AS "group", count(*) AS case_count, {means}
  FROM (SELECT m.*, c.split, c.language FROM {source} m JOIN cases c USING (case_id)) GROUP BY GROUPING SETS ((), (split), (language)))
"""
