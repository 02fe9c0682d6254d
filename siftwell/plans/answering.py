"""Queries of contexts, reranking, extractive answers and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import answers, metrics, rerank
from siftwell.plans import sql as S
from siftwell.plans.fixtures import Corpus
from siftwell.plans.registry import query
from siftwell.plans.retrieval import FULL


def candidates(depth: int, text: str) -> str:
    return f"""
,cd0 AS (SELECT h.case_id, h.document_id, h.rank, list_distinct(list_filter([b.best_chunk_id, d.best_chunk_id], lambda x: x IS NOT NULL)) AS ids, b.best_chunk_id AS bc
  FROM hy h LEFT JOIN bd b USING (case_id, document_id) LEFT JOIN dd d USING (case_id, document_id) WHERE h.rank <= {depth}),
cd1 AS (SELECT case_id, document_id, rank, bc, unnest(ids) AS chunk_id, len(ids) AS n FROM cd0),
cd AS (SELECT case_id, document_id, rank, CASE WHEN n = 1 OR chunk_id = bc THEN 0 ELSE 1 END AS ordinal, chunk_id, {text} AS text FROM cd1 JOIN chunks USING (chunk_id, document_id))
"""


FIRST = f"array_to_string(({S.words('chunks.text')})[1 : 120], ' ')"
TOP10, TOP3 = FULL + candidates(10, "chunks.text"), FULL + candidates(3, FIRST)


@query(TOP10 + " SELECT case_id, document_id, rank, ordinal, chunk_id, length(text) AS chars FROM cd")
def rerank_candidates(c: Corpus):
    rows = answers.candidates(c.hybrid, c.bm25, c.dense, c.chunks_of(c.hybrid), 10)
    return rows.select("case_id", "document_id", F.col("rank").cast("long").alias("rank"), "ordinal", "chunk_id", F.length("text").cast("long").alias("chars"))


RERANKED = TOP10 + f"""
,sc0 AS (SELECT cd.*, list_distinct({S.tok("question")}) AS a, list_distinct({S.tok("text")}) AS b FROM cd JOIN qs USING (case_id)),
sc1 AS (SELECT case_id, document_id, rank, chunk_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0.0), 9) AS score FROM sc0),
rr0 AS (SELECT *, row_number() OVER (PARTITION BY case_id, document_id ORDER BY score DESC, chunk_id) AS r FROM sc1),
rr AS (SELECT case_id, document_id, rank AS original_rank, score, chunk_id AS best_chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, rank, document_id) AS rank FROM rr0 WHERE r = 1)
"""


def _reranked(c: Corpus):
    def make():
        rows = answers.candidates(c.hybrid, c.bm25, c.dense, c.chunks_of(c.hybrid), 10).join(c.questions.select("case_id", "question"), "case_id")
        return rerank.rerank(rows.withColumn("score", rerank.overlap_score(F.col("question"), F.col("text"))))

    return c.keep("reranked", make, True)


@query(RERANKED + " SELECT case_id, rank, document_id, original_rank, round(score, 6) AS score, best_chunk_id FROM rr")
def rerank_documents(c: Corpus):
    return _reranked(c).select("case_id", F.col("rank").cast("long").alias("rank"), "document_id", F.col("original_rank").cast("long").alias("original_rank"), F.round("score", 6).alias("score"), "best_chunk_id")


@query(RERANKED + S.metrics("a", "rr") + S.metrics("b", "hy") + S.summary("x", "a", ["ndcg_at_10"]) + S.summary("y", "b", ["ndcg_at_10"]) + """
SELECT x."group" AS split, round(x.ndcg_at_10 - y.ndcg_at_10, 6) AS delta, round(x.ndcg_at_10 - y.ndcg_at_10, 6) >= CASE WHEN x."group" = 'dev' THEN 0.01 ELSE 0.0 END AS passed
FROM x JOIN y USING ("group") WHERE x."group" IN ('dev', 'test')""")
def rerank_gates(c: Corpus):
    now, old = (metrics.long(metrics.summarise(c.metrics_of(r), ["ndcg_at_10"]), ["ndcg_at_10"], "group") for r in (_reranked(c), c.hybrid))
    d = metrics.deltas(now, old, "group").where(F.col("group").isin("dev", "test"))
    return d.select(F.col("group").alias("split"), "delta", (F.col("delta") >= F.when(F.col("group") == "dev", 0.01).otherwise(0.0)).alias("passed"))


@query(TOP3 + " SELECT case_id, document_id, rank, ordinal, chunk_id, text FROM cd")
def generation_contexts(c: Corpus):
    return c.contexts.select("case_id", "document_id", F.col("rank").cast("long").alias("rank"), "ordinal", "chunk_id", "text")


PATTERN = r"(?i)\b(password|senha|secret|segredo|token|credential|credencial|proprietary|customer)\b"
CUE = "(contains(q_, 'qual') OR contains(q_, 'como') OR contains(q_, 'por que'))"
CONTROL = f"CASE WHEN {CUE} THEN 'Não há fontes recuperadas para sustentar uma resposta.' ELSE 'No retrieved sources are available to support an answer.' END"
HIDDEN = "The corpus does not contain or authorize access to production credentials or customer-specific secrets."
NOTHING = "The retrieved sources do not contain usable evidence for this question."
RAW_JSON = "to_json({'answerable': answerable, 'answer': answer, 'citations': citations})::VARCHAR"
EXTRACTED = TOP3 + rf"""
,s0 AS (SELECT case_id, document_id, rank, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS s FROM cd),
s1 AS (SELECT case_id, document_id, rank, trim(s, ' -' || chr(9)) AS sentence FROM s0),
s2 AS (SELECT s1.*, {S.tok("sentence")} AS t, list_distinct(qt) AS q FROM s1 JOIN qs USING (case_id)),
s3 AS (SELECT *, len(list_intersect(q, list_distinct(t))) AS overlap, len(list_distinct(t)) AS n FROM s2 WHERE len(t) >= 5),
s4 AS (SELECT *, row_number() OVER (PARTITION BY case_id, document_id ORDER BY overlap DESC, n, sentence DESC) AS r FROM s3),
s5 AS (SELECT case_id, string_agg(sentence, ' ' ORDER BY rank) AS answer, list(document_id ORDER BY rank) AS cites FROM s4 WHERE r = 1 GROUP BY case_id),
it AS (SELECT case_id, sum(len({S.tok("text")}))::BIGINT AS input_tokens FROM cd GROUP BY case_id),
ex0 AS (SELECT qs.case_id, question, replace(lower(question), 'ß', 'ss') AS q_, s5.answer AS a, cites, regexp_matches(question, '{PATTERN}') AS hidden, coalesce(input_tokens, 0) AS input_tokens FROM qs LEFT JOIN s5 USING (case_id) LEFT JOIN it USING (case_id)),
ex1 AS (SELECT case_id, NOT hidden AND a IS NOT NULL AS answerable, CASE WHEN hidden THEN '{HIDDEN}' WHEN a IS NULL THEN '{NOTHING}' ELSE a END AS answer, CASE WHEN hidden OR a IS NULL THEN []::VARCHAR[] ELSE cites END AS citations, input_tokens FROM ex0),
ex AS (SELECT *, {RAW_JSON} AS raw_output, len({S.tok(RAW_JSON)})::BIGINT AS output_tokens FROM ex1),
ct0 AS (SELECT case_id, false AS answerable, {CONTROL} AS answer, []::VARCHAR[] AS citations, 0::BIGINT AS input_tokens FROM ex0),
ct AS (SELECT *, {RAW_JSON} AS raw_output, len({S.tok(RAW_JSON)})::BIGINT AS output_tokens FROM ct0)
"""


@query(EXTRACTED + " SELECT case_id, answerable, answer, array_to_string(citations, ',') AS citations, input_tokens, output_tokens FROM ex")
def extractive_answers(c: Corpus):
    return c.extracted.select("case_id", "answerable", "answer", F.array_join("citations", ",").alias("citations"), "input_tokens", "output_tokens")


@query(f"SELECT doc_id, regexp_matches(text, '{PATTERN}') AS sensitive FROM documents WHERE text IS NOT NULL")
def sensitive_questions(c: Corpus):
    return c.table("documents").where("text is not null").select("doc_id", answers.sensitive(F.col("text")).alias("sensitive"))


CUES = [(1, "Qual é a regra?"), (2, "What quality is equal?"), (3, "Como fazer isto?"), (4, "Why so?"), (5, "POR QUE não?")]


@query("SELECT id, " + CONTROL + " AS answer FROM (SELECT *, lower(question) AS q_ FROM (SELECT item_id AS id, text AS question FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT conv_id * 1000 + turn + 1000000, text FROM conversations WHERE role = 'user' AND text IS NOT NULL UNION ALL VALUES "
       + ", ".join(f"(-{i}, '{q}')" for i, q in CUES) + "))")
def no_retrieval_answers(c: Corpus):
    rows = c.questions.select("case_id", "question").unionByName(c.spark.createDataFrame([(-i, q) for i, q in CUES], "case_id long, question string"))
    turns = c.table("conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 1000 + F.col("turn") + 1000000).alias("case_id"), F.col("text").alias("question"))
    return answers.control_answers(rows.unionByName(turns)).select(F.col("case_id").alias("id"), "answer")


SYSTEM = answers.GROUNDED_SYSTEM.replace("'", "''")


@query(TOP3 + f""",bl AS (SELECT case_id, document_id, rank, '<source id="' || document_id || '">' || chr(10) || string_agg('[chunk=' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) || '</source>' AS block FROM cd GROUP BY case_id, document_id, rank)
SELECT qs.case_id, sha256('{SYSTEM}' || chr(1) || 'SOURCES:' || chr(10) || coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank), '') || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question) AS prompt
FROM qs LEFT JOIN bl USING (case_id) GROUP BY qs.case_id, question""")
def prompt_messages(c: Corpus):
    rows = c.questions.join(answers.source_blocks(c.contexts), "case_id", "left").withColumn("m", answers.prompt(F.col("question"), F.coalesce("sources", F.lit(""))))
    return rows.select("case_id", F.sha2(F.array_join(F.transform("m", lambda x: x["content"]), "\x01"), 256).alias("prompt"))


@query(TOP3 + " SELECT cd.case_id, document_id, chunk_id, list_contains(r.docs, document_id) AS cited FROM cd JOIN (SELECT case_id, list(DISTINCT document_id) AS docs FROM rel GROUP BY case_id) r USING (case_id)")
def evidence_passages(c: Corpus):
    gold = c.relevant.groupBy("case_id").agg(F.collect_set("document_id").alias("docs"))
    return c.contexts.join(gold, "case_id").select("case_id", "document_id", "chunk_id", F.array_contains("docs", F.col("document_id")).alias("cited"))


QT = S.tok("question")
AT = S.tok("answer")


def bigrams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


ANSWERED = EXTRACTED + f"""
,ev AS (SELECT cd.case_id, string_agg(text, ' ' ORDER BY rank, ordinal) AS evidence FROM cd JOIN ex ON ex.case_id = cd.case_id AND list_contains(ex.citations, cd.document_id) GROUP BY cd.case_id),
av AS (SELECT case_id, list(DISTINCT document_id) AS available FROM cd GROUP BY case_id),
gd AS (SELECT case_id, list(DISTINCT document_id) AS gold FROM rel GROUP BY case_id),
an0 AS (SELECT c.case_id, c.split, c.language, c.answerable AS ca, coalesce(gold, []::VARCHAR[]) AS gold, coalesce(available, []::VARCHAR[]) AS available, ex.answerable, ex.answer, ex.citations, coalesce(evidence, '') AS evidence,
  array_to_string(({S.words("question")})[1 : 30], ' ') AS reference, c.qt, ceil(len(c.qt) / 3.0)::BIGINT AS third FROM cases c JOIN ex USING (case_id) LEFT JOIN ev USING (case_id) LEFT JOIN av USING (case_id) LEFT JOIN gd USING (case_id)),
an1 AS (SELECT *, {S.tok("answer")} AS a_t, {S.tok("reference")} AS rt, {S.tok("evidence")} AS et, list_filter([array_to_string(qt[1 : third], ' '), array_to_string(qt[third + 1 : 2 * third], ' '), array_to_string(qt[2 * third + 1 : 3 * third], ' ')], lambda x: x <> '') AS facts FROM an0),
an2 AS (SELECT *, list_sum(list_transform(list_distinct(a_t), lambda t: least(len(list_filter(a_t, lambda x: x = t)), len(list_filter(rt, lambda x: x = t)))))::BIGINT AS shared,
  len(list_intersect(citations, gold)) AS hits, {bigrams("a_t")} AS ab, {bigrams("et")} AS eb FROM an1),
am AS (SELECT case_id, true AS schema_valid, answerable = ca AS answerability_correct, len(list_filter(citations, lambda x: NOT list_contains(available, x))) = 0 AS citation_valid,
  CASE WHEN ca THEN hits > 0 END AS relevant_citation_hit, CASE WHEN ca AND len(citations) > 0 THEN round(hits / len(citations)::DOUBLE, 6) END AS citation_precision,
  CASE WHEN ca AND len(gold) > 0 THEN round(hits / len(gold)::DOUBLE, 6) END AS citation_recall,
  round(CASE WHEN len(a_t) = 0 OR len(rt) = 0 OR coalesce(shared, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * shared / (len(a_t) + len(rt)) END, 6) AS token_f1,
  CASE WHEN ca AND len(facts) > 0 THEN round(len(list_filter(facts, lambda f: len(list_intersect(list_distinct({S.tok("f")}), list_distinct(a_t))) / len(list_distinct({S.tok("f")}))::DOUBLE >= 0.55)) / len(facts)::DOUBLE, 6) END AS fact_coverage,
  CASE WHEN len(citations) > 0 THEN round(CASE WHEN len(ab) = 0 THEN 0.0 ELSE len(list_intersect(ab, eb)) / len(ab)::DOUBLE END, 6) END AS bigram_support,
  (contains(array_to_string(a_t, ' '), 'guaranteed forever')::INT + contains(array_to_string(a_t, ' '), 'the')::INT)::INT AS forbidden_claim_hits,
  CASE WHEN NOT ca THEN NOT answerable END AS refusal_correct FROM an2)
"""


def measured(c: Corpus):
    return c.keep("measured", lambda: answers.answer_metrics(c.answer_rows()), True)


FLAGS = ("schema_valid", "answerability_correct", "citation_valid", "relevant_citation_hit", "refusal_correct")


@query(ANSWERED + " SELECT case_id, citation_precision, citation_recall, " + ", ".join(f"coalesce({f}::INT, -1)::INT AS {f}" for f in FLAGS) + " FROM am")
def answer_metrics(c: Corpus):
    """Flags as 1, 0, or -1 where they don't apply."""
    return measured(c).select("case_id", "citation_precision", "citation_recall", *(F.coalesce(F.col(f).cast("int"), F.lit(-1)).alias(f) for f in FLAGS))


for _name in ("token_f1", "fact_coverage", "bigram_support"):
    query(ANSWERED + f" SELECT case_id, {_name} FROM am", _name)(lambda c, n=_name: measured(c).select("case_id", n))


@query(ANSWERED + " SELECT case_id, forbidden_claim_hits AS hits FROM am")
def forbidden_claims(c: Corpus):
    return measured(c).select("case_id", F.col("forbidden_claim_hits").alias("hits"))


def measured_control(c: Corpus):
    rows = c.answer_rows().drop("answerable", "answer", "citations").join(answers.control_answers(c.questions.select("case_id", "question")).select("case_id", "answerable", "answer", "citations"), "case_id")
    return answers.answer_metrics(rows, retrieval=False)


MEANS = ", ".join(f"round(avg({m}::INT::DOUBLE), 6) AS {m}" if m in FLAGS else f"round(avg({m}), 6) AS {m}" for m in answers.ANSWER_METRICS)
SUMMED = ANSWERED + f""",c1 AS (SELECT an1.* EXCLUDE (answer, a_t), ct.answer, {S.tok("ct.answer")} AS a_t FROM an1 JOIN ct USING (case_id)),
c2 AS (SELECT *, list_sum(list_transform(list_distinct(a_t), lambda t: least(len(list_filter(a_t, lambda x: x = t)), len(list_filter(rt, lambda x: x = t)))))::BIGINT AS shared FROM c1),
cm AS (SELECT case_id, true AS schema_valid, NOT ca AS answerability_correct, true AS citation_valid, NULL::BOOLEAN AS relevant_citation_hit, NULL::DOUBLE AS citation_precision, NULL::DOUBLE AS citation_recall,
  round(CASE WHEN len(a_t) = 0 OR len(rt) = 0 OR coalesce(shared, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * shared / (len(a_t) + len(rt)) END, 6) AS token_f1,
  CASE WHEN ca AND len(facts) > 0 THEN round(len(list_filter(facts, lambda f: len(list_intersect(list_distinct({S.tok("f")}), list_distinct(a_t))) / len(list_distinct({S.tok("f")}))::DOUBLE >= 0.55)) / len(facts)::DOUBLE, 6) END AS fact_coverage,
  NULL::DOUBLE AS bigram_support, NULL::INT AS forbidden_claim_hits, CASE WHEN NOT ca THEN true END AS refusal_correct FROM c2),
gs AS (SELECT mode, CASE WHEN split IS NOT NULL THEN split WHEN language IS NOT NULL THEN 'language:' || language ELSE 'all' END AS "group", count(*) AS case_count, {MEANS}, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens
  FROM (SELECT 'grounded' AS mode, am.*, an1.split, an1.language, ex.input_tokens, ex.output_tokens FROM am JOIN an1 USING (case_id) JOIN ex USING (case_id)
  UNION ALL SELECT 'no_retrieval', cm.*, an1.split, an1.language, ct.input_tokens, ct.output_tokens FROM cm JOIN an1 USING (case_id) JOIN ct USING (case_id)) GROUP BY GROUPING SETS ((mode), (mode, split), (mode, language)))
"""


def summed(c: Corpus):
    """Summary of both modes: mode, group, means, tokens."""
    groups = c.cases.select("case_id", "split", "language")
    control = answers.control_answers(c.questions.select("case_id", "question"))
    modes = (("grounded", measured(c), c.extracted), ("no_retrieval", measured_control(c), control))
    rows = [m.join(groups, "case_id").join(a.select("case_id", "input_tokens", "output_tokens"), "case_id").withColumn("mode", F.lit(name)) for name, m, a in modes]
    return metrics.summarise(rows[0].unionByName(rows[1]), answers.ANSWER_METRICS, ["input_tokens", "output_tokens"], "mode")


@query(SUMMED + " SELECT * FROM gs")
def generation_summary(c: Corpus):
    return summed(c)


@query(SUMMED + """ SELECT gate, observed, observed >= least_ AS passed FROM (
 SELECT 'schema' AS gate, schema_valid AS observed, 1.0 AS least_ FROM gs WHERE mode = 'grounded' AND "group" = 'all' UNION ALL SELECT 'citation', citation_valid, 1.0 FROM gs WHERE mode = 'grounded' AND "group" = 'all'
 UNION ALL SELECT 'refusal', refusal_correct, 1.0 FROM gs WHERE mode = 'grounded' AND "group" = 'all' UNION ALL SELECT 'hit', relevant_citation_hit, 0.8 FROM gs WHERE mode = 'grounded' AND "group" = 'all'
 UNION ALL SELECT 'fact_delta', round(a.fact_coverage - b.fact_coverage, 6), 0.1 FROM gs a JOIN gs b USING ("group") WHERE a.mode = 'grounded' AND b.mode = 'no_retrieval' AND "group" = 'dev')""")
def generation_gates(c: Corpus):
    both = c.keep("summed", lambda: summed(c), True)
    return answers.generation_gates(both.where("mode = 'grounded'"), both.where("mode = 'no_retrieval'"))


#: Raw outputs: fenced with a repeated citation, plain text, an extra key, a wrong type, nothing.
RAW = [
    (1, '```json\n{"answerable": true, "answer": "Yes.", "citations": ["a", "a", "b"]}\n```', True, True, "Yes.", "a,b"),
    (2, "no object here", False, False, "no object here", ""),
    (3, '{"answerable": true, "answer": "x", "citations": [], "more": 1}', False, False, '{"answerable": true, "answer": "x", "citations": [], "more": 1}', ""),
    (4, '{"answerable": "yes", "answer": "x", "citations": []}', True, True, "x", ""),
    (6, '{"answerable": false, "answer": "", "citations": []}', False, False, '{"answerable": false, "answer": "", "citations": []}', ""),
    (7, '{"answerable": 0, "answer": "x", "citations": ["b"]} thanks', True, False, "x", "b"),
    (8, '{"answerable": 2, "answer": "x", "citations": []}', False, False, '{"answerable": 2, "answer": "x", "citations": []}', ""),
    (9, '{"answerable": true, "answer": "x", "citations": [1]}', False, False, '{"answerable": true, "answer": "x", "citations": [1]}', ""),
    (10, "   ", False, False, "Invalid empty model output.", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(v).lower()}, {str(a).lower()}, '{t}', '{k}')" for i, _, v, a, t, k in RAW) + ") t(case_id, schema_valid, answerable, answer, citations)")
def parse_generation(c: Corpus):
    """Fixed texts; what is expected of them is written out in RAW."""
    rows = c.spark.createDataFrame([(i, r) for i, r, *_ in RAW], "case_id int, raw_output string")
    return answers.parse_generations(rows).select("case_id", "schema_valid", "answerable", "answer", F.array_join("citations", ",").alias("citations"))


@query("SELECT event_id, nullif(regexp_extract(props, '(?s)\\{.*\\}'), '') AS body FROM events")
def json_extract(c: Corpus):
    return c.table("events").select("event_id", answers.json_object(F.col("props")).alias("body"))
