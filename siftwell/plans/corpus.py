"""Queries of the corpus: manifests, hashes, chunking, allow-lists, caches, reports, dataset contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.text import windows
from siftwell.operators import chunking, contracts, dense, gates, metrics
from siftwell.plans import sql as S
from siftwell.plans.fixtures import Corpus
from siftwell.plans.registry import query
from siftwell.session import scratch
from siftwell.sources import corpus as files

CHUNKS = "WITH " + S.CHUNKS
#: Documents stand for files: path, extension and size come from source, language and text.
PATHS = "SELECT doc_id, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.bin' ELSE '.md' END AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL"


def as_files(c: Corpus):
    d = c.table("documents").where("text is not null")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".bin").otherwise(".md")))
    return d.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query(f"SELECT path, bytes::BIGINT AS bytes, sha256 FROM ({PATHS})")
def corpus_manifest(c: Corpus):
    return as_files(c).select("path", "bytes", "sha256")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def content_sha256(c: Corpus):
    return as_files(c).select("doc_id", "sha256")


@query(f"SELECT path FROM ({PATHS}) WHERE (path LIKE 'src1%' OR path LIKE '%/en/%') AND NOT (path LIKE '%.bin' OR path LIKE 'src13/%')")
def allowlist_filter(c: Corpus):
    return as_files(c).where(files.selected(F.col("path"), ["src1*", "*/en/*"], ["*.bin", "src13/*"])).select("path")


@query(f"SELECT path, 'extension' AS rule FROM ({PATHS}) WHERE path LIKE '%.bin' UNION ALL SELECT path, 'size' FROM ({PATHS}) WHERE bytes > 4096")
def corpus_violations(c: Corpus):
    return files.file_violations(as_files(c), [".md", ".yaml"], 4096)


@query(CHUNKS + " SELECT document_id, ordinal, array_to_string(ws[ordinal * 180 + 1 : ordinal * 180 + 220], ' ') AS \"window\" FROM cut")
def chunk_word_windows(c: Corpus):
    return c.documents.select("document_id", F.posexplode(windows(F.col("text"), chunking.MAX_WORDS, chunking.OVERLAP_WORDS)).alias("ordinal", "window")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(CHUNKS + " SELECT document_id, ordinal, chunk_id FROM chunks")
def chunk_ids(c: Corpus):
    return c.chunks.select("document_id", "ordinal", "chunk_id")


@query(CHUNKS + " SELECT heading, count(*) AS chunks, count(DISTINCT document_id) AS documents, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY heading")
def chunk_index_summary(c: Corpus):
    return c.chunks.groupBy("heading").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.sum(F.length("text")).alias("chars"))


#: Markdown made from pages: headings become # lines, other tags go.
MD = r"""WITH md AS (SELECT page_id::VARCHAR AS document_id, 'page-' || page_id AS stem,
 regexp_replace(regexp_replace(regexp_replace(html, '<h([1-6])[^>]*>(.*?)</h[1-6]>', chr(10) || '## \2' || chr(10), 'gs'), '</p>', chr(10) || '### p' || chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages WHERE html IS NOT NULL),
ln AS (SELECT document_id, stem, unnest(range(len(l))) AS line, unnest(l) AS value FROM (SELECT *, string_split(text, chr(10)) AS l FROM md)),
hd AS (SELECT document_id, line, length(regexp_extract(value, '^(#{1,6})\s+(.+?)\s*$', 1)) AS level, regexp_extract(value, '^(#{1,6})\s+(.+?)\s*$', 2) AS title FROM ln WHERE regexp_matches(value, '^(#{1,6})\s+(.+?)\s*$'))
"""

def markdown(c: Corpus):
    text = F.col("html")
    for pattern, to in ((r"(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>", "\n## $2\n"), ("</p>", "\n### p\n"), ("<[^>]*>", "")):
        text = F.regexp_replace(text, pattern, to)
    return c.table("pages").where("html is not null").select(F.col("page_id").cast("string").alias("document_id"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("stem"), text.alias("text"))


@query(MD + " SELECT document_id, line::INT AS line, level::INT AS level, title FROM hd")
def markdown_headings(c: Corpus):
    return chunking.headings(markdown(c))


STACK = MD + """,r AS (SELECT document_id, line, level, title, row_number() OVER (PARTITION BY document_id ORDER BY line) AS k FROM hd),
rc AS (WITH RECURSIVE s(document_id, k, line, stack) AS (SELECT document_id, k, line, [title] FROM r WHERE k = 1
  UNION ALL SELECT r.document_id, r.k, r.line, list_concat(s.stack[1 : r.level - 1], [r.title]) FROM s JOIN r ON r.document_id = s.document_id AND r.k = s.k + 1) SELECT * FROM s)
"""


@query(STACK + " SELECT document_id, line::INT AS line, array_to_string(stack, ' > ') AS breadcrumb FROM rc")
def markdown_breadcrumbs(c: Corpus):
    return chunking.heading_paths(markdown(c))


SECTIONS = STACK + r""",sl AS (SELECT l.document_id, l.line, l.value, l.stem, array_to_string(rc.stack, ' > ') AS bread, count(rc.line) OVER (PARTITION BY l.document_id ORDER BY l.line) AS section FROM ln l LEFT JOIN rc ON rc.document_id = l.document_id AND rc.line = l.line),
sec AS (SELECT document_id, section, coalesce(max(bread), replace(max(stem), '-', ' ')) AS heading, regexp_replace(coalesce(string_agg(value, chr(10) ORDER BY line) FILTER (WHERE bread IS NULL), ''), '^\s+|\s+$', '', 'g') AS body FROM sl GROUP BY ALL),
sw AS (SELECT *, """ + S.words("body") + r""" AS ws FROM sec WHERE body <> ''),
sk AS (SELECT *, unnest(range(CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 220 THEN 1 ELSE 1 + ceil((len(ws) - 220) / 180.0)::BIGINT END)) AS i FROM sw),
sc AS (SELECT document_id, heading, row_number() OVER (PARTITION BY document_id ORDER BY section, i) - 1 AS ordinal, regexp_replace(heading || chr(10) || array_to_string(ws[i * 180 + 1 : i * 180 + 220], ' '), '^\s+|\s+$', '', 'g') AS text FROM sk)
"""
SELECT_SECTIONS = " SELECT document_id, heading, ordinal::INT AS ordinal, document_id || '::' || lpad(ordinal::VARCHAR, 4, '0') || '::' || substr(sha256(text), 1, 12) AS chunk_id, text FROM sc"


@query(SECTIONS + SELECT_SECTIONS)
def chunk_markdown(c: Corpus):
    return chunking.chunk_markdown(markdown(c)).select("document_id", "heading", "ordinal", "chunk_id", "text")


OPENAPI = """openapi: 3.0.0
info: {title: Shelf, version: '1'}
paths:
  /books:
    post: {summary: Add a book, operationId: addBook}
    get: {summary: List books, tags: [read]}
  /authors:
    get: {description: List authors}
components:
  schemas:
    Book: {type: object, properties: {title: {type: string}}}
    Author: {type: object}
"""


#: What the specification's chunks have to be: heading and words behind it, for each in order.
OPENAPI_CHUNKS = [
    ("API information", "title: Shelf version: '1'"),
    ("GET /authors", "GET /authors description: List authors"),
    ("GET /books", "GET /books summary: List books tags: - read"),
    ("POST /books", "POST /books operationId: addBook summary: Add a book"),
    ("components > schemas > Author", "type: object"),
    ("components > schemas > Book", "properties: title: type: string type: object"),
]
OPENAPI_VALUES = ", ".join("({}, '{}', '{}')".format(i, h, w.replace("'", "''")) for i, (h, w) in enumerate(OPENAPI_CHUNKS))


@query(f"""SELECT document_id, heading, ordinal, document_id || '::' || lpad(ordinal::VARCHAR, 4, '0') || '::' || substr(sha256(text), 1, 12) AS chunk_id, text
FROM (SELECT d.lang || '.yaml' AS document_id, heading, ordinal, heading || chr(10) || body AS text FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) d, (VALUES {OPENAPI_VALUES}) t(ordinal, heading, body))""")
def chunk_openapi(c: Corpus):
    """One specification for each language of the corpus."""
    docs = c.table("documents").where("lang is not null").select("lang").distinct().select(F.concat("lang", F.lit(".yaml")).alias("document_id"), F.concat(F.lit(OPENAPI), F.lit("x-language: "), "lang", F.lit("\n")).alias("text"))
    return chunking.chunk_openapi(docs).select("document_id", "heading", "ordinal", "chunk_id", "text")


@query(SECTIONS + " SELECT 'markdown' AS kind, count(*) AS chunks FROM sc UNION ALL SELECT 'openapi', 6")
def chunk_dispatch(c: Corpus):
    docs = markdown(c).select("document_id", F.concat("stem", F.lit(".md")).alias("source_path"), "text")
    spec = c.spark.createDataFrame([("spec", "api/spec.YAML", OPENAPI)], "document_id string, source_path string, text string")
    return chunking.chunk_documents(docs.unionByName(spec)).groupBy("kind").agg(F.count("*").alias("chunks"))


DIMENSIONS = 64


@query("SELECT label AS index_id, count(*) AS chunks, min(len(embedding))::INT AS dimensions, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS norm FROM embeddings WHERE len(embedding) = 64 GROUP BY label")
def vector_index_stats(c: Corpus):
    """Statistics of an index that was written and read again."""
    rows = c.table("embeddings").where(F.size("embedding") == DIMENSIONS).select(F.col("vec_id").cast("string").alias("chunk_id"), "label", "embedding")
    out = scratch(c.spark, "vector-index")
    files.replace_index(rows, "vectors", DIMENSIONS, out)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    read = c.spark.read.parquet(out).where("index_id = 'vectors'")
    return read.groupBy(F.col("label").alias("index_id")).agg(F.count("*").alias("chunks"), F.min(F.size("embedding")).alias("dimensions"), F.round(F.avg(norm), 5).alias("norm"))


@query(CHUNKS + " SELECT chunk_id FROM chunks WHERE document_id::BIGINT % 3 <> 0")
def embedding_cache_missing(c: Corpus):
    cached = c.chunks.where(F.col("document_id").cast("long") % 3 == 0).select("chunk_id", F.array(F.lit(0.0)).alias("embedding"))
    return dense.missing_embeddings(c.chunks.select("chunk_id"), cached)


@query("WITH " + S.TOKENS + S.CASES + " SELECT case_id, split, answerable, language, n_relevant::INT AS n_relevant FROM cases")
def golden_cases(c: Corpus):
    return c.cases.select("case_id", "split", "answerable", "language", F.size("relevant_documents").alias("n_relevant"))


@query("WITH " + S.TOKENS + S.CASES + " SELECT split, count(*) AS cases, count(*) FILTER (WHERE answerable) AS answerable, count(DISTINCT language) AS languages FROM cases GROUP BY split")
def dataset_validation(c: Corpus):
    return c.cases.groupBy("split").agg(F.count("*").alias("cases"), F.count_if("answerable").alias("answerable"), F.count_distinct("language").alias("languages"))


@query("WITH " + S.TOKENS + S.CASES + """ SELECT case_id AS id, rule FROM (
 SELECT case_id, CASE WHEN language NOT IN ('en', 'pt-BR') THEN 'language' END AS rule FROM cases UNION ALL SELECT case_id, CASE WHEN length(question) < 15 THEN 'question_length' END FROM cases
 UNION ALL SELECT case_id, CASE WHEN answerable THEN 'answerable_needs_facts' END FROM cases WHERE case_id % 2 = 0) WHERE rule IS NOT NULL""")
def golden_violations(c: Corpus):
    facts = F.when(F.col("case_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a fact")))
    rows = c.cases.withColumn("required_facts", facts).withColumn("reference_answer", F.lit("a reference answer"))
    return contracts.violations(rows, "case_id", contracts.golden_rules())


@query("SELECT text AS id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_ids(c: Corpus):
    return contracts.duplicates(c.table("documents").where("text is not null"), "text")


@query("SELECT DISTINCT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE source <> 'src3') d USING (doc_id)")
def labels_missing_from_corpus(c: Corpus):
    return c.table("labels").select("doc_id").distinct().join(c.table("documents").where("source <> 'src3'").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT doc_id::VARCHAR AS id, CASE doc_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'lf' END AS matched, doc_id % 3 <> 2 AS passed FROM documents WHERE text IS NOT NULL AND contains(text, chr(10)) AND doc_id % 5 <> 0""")
def provenance_check(c: Corpus):
    d = c.table("documents").where("text is not null").where(F.contains("text", F.lit("\n")))
    kind = F.col("doc_id") % 3
    content = F.when(kind == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    path = F.concat(F.when(F.col("doc_id") % 5 == 0, ".data/").otherwise("docs/"), F.col("doc_id").cast("string"))
    rows = d.select(F.col("doc_id").cast("string").alias("id"), path.alias("path"), content.alias("content"), F.when(kind == 2, F.lit("0" * 64)).otherwise(F.sha2("text", 256)).alias("expected"))
    return gates.provenance(rows)


@query("WITH " + S.TOKENS + S.CASES + S.BM25 + S.metrics("m", "bd") + S.summary("s", "m") + """ SELECT CASE "group" WHEN 'all' THEN 1 WHEN 'dev' THEN 2 WHEN 'test' THEN 3 WHEN 'language:en' THEN 4 ELSE 5 END AS place,
 '| ' || "group" || ' | ' || case_count || ' | ' || printf('%.3f', recall_at_5) || ' | ' || printf('%.3f', recall_at_10) || ' | ' || printf('%.3f', mrr_at_10) || ' |' AS line FROM s WHERE "group" IN ('all', 'dev', 'test', 'language:en', 'language:pt-BR')""")
def report_markdown_rows(c: Corpus):
    return files.markdown_rows(metrics.summarise(c.metrics_of(c.bm25), metrics.METRICS), ["recall_at_5", "recall_at_10", "mrr_at_10"])


@query("SELECT item_id AS case_id, NULL::VARCHAR AS label, NULL::VARCHAR AS reviewer FROM benchmark WHERE text IS NOT NULL")
def label_template(c: Corpus):
    """The template as it is read back from its JSON lines."""
    out = scratch(c.spark, "label-template")
    files.write_jsonl(c.questions.select("case_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("reviewer")), out)
    return files.read_jsonl(c.spark, out, "case_id long, label string, reviewer string", "case_id")


@query("WITH " + S.CHUNKS + " SELECT source AS report, count(DISTINCT lang) AS inputs, count(DISTINCT lang) = 1 AS consistent FROM docs GROUP BY source")
def input_consistency(c: Corpus):
    n = F.count_distinct("lang")
    return c.documents.groupBy(F.col("source").alias("report")).agg(n.alias("inputs"), (n == 1).alias("consistent"))
