"""Queries on golden data, evaluation, diagnosis, assembly and judged metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import claims, verdict
from corpusloom.operators import assemble, diagnose, evaluate, fusion, golden, judged
from corpusloom.plans import inputs, retrieval
from corpusloom.runtime import stage, table


def q_fact_spans(spark: SparkSession, d: str) -> DataFrame:
    return golden.fact_spans(inputs.facts(spark, d), inputs.documents(spark, d))


def _fact_chunks(spark: SparkSession, d: str) -> DataFrame:
    return golden.fact_chunks(q_fact_spans(spark, d), inputs.corpus(spark, d))


def q_fact_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _fact_chunks(spark, d)


def q_evidence_trace(spark: SparkSession, d: str) -> DataFrame:
    x = golden.evidence_trace(inputs.pairs(spark, d), inputs.facts(spark, d), _fact_chunks(spark, d))
    return x.withColumn("expected_chunk", F.coalesce(F.array_join("expected_chunk", ","), F.lit("")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation_records(inputs.expectations(spark, d), inputs.observations(spark, d))


def q_retrieval_evaluation(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return r.select("id", "classification", *(F.array_join(c, ",").alias(c) for c in ("matched_chunk_ids", "missing_chunk_ids", "unexpected_chunk_ids")), "expected_count", "observed_count", "matched_count")


def q_unmatched_ids(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.unmatched_ids(inputs.expectations(spark, d).select("id"), inputs.observations(spark, d).select("id"))


def q_evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation_summary(_records(spark, d))


def q_document_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.document_distribution(_records(spark, d), inputs.corpus(spark, d))


def q_metrics_classification(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.classification_counts(_records(spark, d))


def q_metrics_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.retrieval_metrics(_records(spark, d))


def q_metrics_per_question(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.question_metrics(_records(spark, d))


def q_metrics_independent_check(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.independent_check(_records(spark, d))


def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.run_summary(inputs.observations(spark, d), inputs.corpus(spark, d).agg(F.count("*").alias("n")))


def _route_records(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    corpus, sem, lex = retrieval._routes(spark, d)
    fused = fusion.reciprocal_rank_fusion(sem, lex, corpus, retrieval.K)
    questions = inputs.questions(spark, d)
    expected = inputs.expectations(spark, d).join(questions.select(F.concat(F.lit("meta_"), "query_id").alias("id")).hint("merge"), "id")
    seen = lambda x: x.groupBy("query_id").agg(F.collect_set("id").alias("observed_chunk")).select(F.concat(F.lit("meta_"), "query_id").alias("id"), "observed_chunk")
    return {name: evaluate.evaluation_records(expected, seen(x)) for name, x in (("semantic", sem), ("lexical", lex), ("fused", fused))}


def q_route_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = [evaluate.retrieval_metrics(r).join(evaluate.classification_counts(r)).select(F.lit(name).alias("route"), "questions", "hits", "hit_rate", "precision_micro", "precision_macro", "recall_micro", "recall_macro") for name, r in _route_records(spark, d).items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def q_metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    r = _route_records(spark, d)
    long = lambda x: evaluate.as_metrics(evaluate.retrieval_metrics(x))
    return evaluate.metric_deltas(long(r["lexical"]), long(r["fused"]))


def _diagnosed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = stage(evaluate.with_documents(_records(spark, d), inputs.corpus(spark, d)), "records")
    return r, evaluate.question_metrics(r)


def q_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    x = diagnose.diagnoses(*_diagnosed(spark, d))
    return x.select("id", "rule_id", "documented_rule", "documented_metric", "documented_investigation", "responsible_component", "altm_stage", "diagnosis_confidence", "classification", "chunk_recall_at_k", "chunk_precision_at_k", F.array_join("expected_document_ids", ",").alias("expected_document_ids"), F.array_join("observed_document_ids", ",").alias("observed_document_ids"))


def q_diagnosis_summary(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.diagnosis_summary(diagnose.diagnoses(*_diagnosed(spark, d)))


def q_diagnosis_check(spark: SparkSession, d: str) -> DataFrame:
    """Questions on which the two derivations of the diagnosis differ: none."""
    r, m = _diagnosed(spark, d)
    a, b = diagnose.diagnoses(r, m).select("id", "rule_id"), diagnose.second_derivation(r, m)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def q_rule_table(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.rule_table(spark).select("row_no", "rule_id", "symptom", F.array_join("stages", " or ").alias("stages"), "component", "metric", "investigation", "stage")


def _prompted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = stage(inputs.corpus(spark, d), "corpus")
    queries = stage(inputs.questions(spark, d), "questions")
    from corpusloom.operators.lexical import bm25

    found = stage(bm25(corpus, queries, retrieval.K), "lexical")
    return queries, found, stage(assemble.resolved(found, corpus), "passages")


def q_prompt_context(spark: SparkSession, d: str) -> DataFrame:
    queries, _, passages = _prompted(spark, d)
    return assemble.prompts(queries, passages).select("query_id", F.sha2("context", 256).alias("h"), F.length("context").alias("n"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


def q_prompt_offsets(spark: SparkSession, d: str) -> DataFrame:
    return assemble.passage_offsets(_prompted(spark, d)[2])


def q_generation_result(spark: SparkSession, d: str) -> DataFrame:
    queries, _, passages = _prompted(spark, d)
    return assemble.answers(queries, passages).select("query_id", "outcome", F.sha2("answer_text", 256).alias("h"), F.size("statements").alias("statements"))


def q_trace_records(spark: SparkSession, d: str) -> DataFrame:
    corpus, sem, lex = retrieval._routes(spark, d)
    queries = inputs.questions(spark, d)
    candidates = stage(fusion.fused_candidates(sem, lex, corpus), "candidates")
    passages = stage(assemble.resolved(candidates.where(F.col("rank") <= retrieval.K), corpus), "passages")
    records = assemble.traces(queries, candidates, assemble.prompts(queries, passages), assemble.answers(queries, passages), retrieval.K)
    # Flattened, so that the records can be compared; rank, routes' ranks and score in millionths of every candidate.
    shown = F.transform("retrieval.candidates", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["id"], F.coalesce(c["semantic_rank"].cast("string"), F.lit("-")), F.coalesce(c["lexical_rank"].cast("string"), F.lit("-")), F.round(c["score"] * 1e6).cast("long").cast("string"), c["selected"].cast("string")))
    chunks = lambda of: F.transform(of, lambda p: p["chunk_id"])
    return records.select(
        "query_id", F.col("query.question").alias("question"), F.col("retrieval.route").alias("route"), F.col("retrieval.top_k").alias("top_k"), F.coalesce(F.array_join(shown, ","), F.lit("")).alias("candidates"), F.array_join("assembly.chunk_ids", ",").alias("chunk_ids"),
        F.array_join(chunks("assembly.provenance"), ",").alias("provenance"), F.col("generation.outcome").alias("outcome"), F.sha2("generation.answer_text", 256).alias("answer"), F.array_join(F.flatten(F.transform("generation.statements", lambda s: chunks(s["supporting_evidence"]))), ",").alias("evidence"),
    )


def q_trace_violations(spark: SparkSession, d: str) -> DataFrame:
    corpus, sem, lex = retrieval._routes(spark, d)
    queries = inputs.questions(spark, d)
    candidates = stage(fusion.fused_candidates(sem, lex, corpus), "candidates")
    passages = stage(assemble.resolved(candidates.where(F.col("rank") <= retrieval.K), corpus), "passages")
    return assemble.trace_violations(assemble.traces(queries, candidates, assemble.prompts(queries, passages), assemble.answers(queries, passages), retrieval.K))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Latest generations with the chunks they rest on as context, and the reference answer."""
    g = inputs.generations(spark, d).select(F.col("qa_id").alias("id"), "question", "answer_text", "outcome", F.array_distinct(F.filter(F.flatten(F.transform("statements", lambda s: F.transform(s["supporting_evidence"], lambda e: e["chunk_id"]))), lambda x: x.isNotNull())).alias("ids"))
    passages = g.select("id", F.explode("ids").alias("chunk_id")).join(inputs.corpus(spark, d).select(F.col("id").alias("chunk_id"), "text"), "chunk_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_id").alias("id"), "text"))).alias("passages"))
    reference = inputs.pairs(spark, d).select("id", F.coalesce("expected_answer", F.lit("")).alias("reference"))
    return g.drop("ids").join(passages, "id", "left").join(reference, "id", "left").select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer_text", F.lit("")).alias("answer_text"), F.coalesce("outcome", F.lit("Answer")).alias("outcome"), F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("passages", F.array().cast("array<struct<id:string,text:string>>")).alias("passages"))


def q_context_precision(spark: SparkSession, d: str) -> DataFrame:
    return judged.context_precision(_cases(spark, d))


def q_context_precision_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return judged.precision_aggregate(judged.context_precision(_cases(spark, d)))


def q_context_recall(spark: SparkSession, d: str) -> DataFrame:
    return judged.context_recall(_cases(spark, d))


def q_context_recall_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return judged.recall_aggregate(judged.context_recall(_cases(spark, d)))


def q_claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return judged.claim_verdicts(_cases(spark, d)).drop("claim")


def _claim_metrics(spark: SparkSession, d: str) -> DataFrame:
    cases = stage(_cases(spark, d), "cases")
    return judged.claim_metrics(cases, judged.claim_verdicts(cases))


def q_claim_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _claim_metrics(spark, d)


def q_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    return judged.claim_aggregate(_claim_metrics(spark, d), "faithfulness", "faithful")


def q_groundedness(spark: SparkSession, d: str) -> DataFrame:
    return judged.claim_aggregate(_claim_metrics(spark, d), "groundedness", "grounded")


def q_hallucination_rate(spark: SparkSession, d: str) -> DataFrame:
    return judged.claim_aggregate(_claim_metrics(spark, d), "hallucination_rate", "hallucinated")


def q_answer_relevancy(spark: SparkSession, d: str) -> DataFrame:
    return judged.relevancy(_cases(spark, d))


def q_answer_relevancy_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return judged.relevancy_aggregate(judged.relevancy(_cases(spark, d)))


def q_verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every outcome of the generations read as a verdict of the vocabulary Answer and Abstain."""
    return table(spark, d, "generation_results").select("id", "outcome").distinct().select("id", verdict(F.col("outcome"), ("ANSWER", "ABSTAIN")).alias("verdict"))


def q_claim_parse(spark: SparkSession, d: str) -> DataFrame:
    """The claims of every generated answer."""
    return inputs.generations(spark, d).where("answer_text IS NOT NULL").select("qa_id", F.posexplode(claims(F.col("answer_text"))).alias("n", "claim"))


QUERIES = {
    f.__name__: f
    for f in (
        q_fact_spans, q_fact_chunks, q_evidence_trace, q_retrieval_evaluation, q_unmatched_ids, q_evaluation_summary, q_document_distribution, q_metrics_classification, q_metrics_retrieval, q_metrics_per_question, q_metrics_independent_check,
        q_run_summary, q_route_comparison, q_metric_deltas, q_diagnosis, q_diagnosis_summary, q_diagnosis_check, q_rule_table, q_prompt_context, q_prompt_offsets, q_generation_result, q_trace_records, q_trace_violations, q_context_precision,
        q_context_precision_aggregate, q_context_recall, q_context_recall_aggregate, q_claim_verdicts, q_claim_metrics, q_faithfulness, q_groundedness, q_hallucination_rate, q_answer_relevancy, q_answer_relevancy_aggregate, q_verdict_parse, q_claim_parse,
    )
}

_F = "WITH " + inputs.CORPUS + ", " + inputs.FACTS + """,
spans AS (SELECT f.id AS fact_id, f.document_id, CAST(strpos(d.text, f.source_text) - 1 AS INT) AS start, CAST(CASE WHEN strpos(d.text, f.source_text) > 0 THEN strpos(d.text, f.source_text) - 1 + length(f.source_text) ELSE -1 END AS INT) AS "end",
  CAST((length(d.text) - length(replace(d.text, f.source_text, ''))) // length(f.source_text) AS INT) AS occurrences
  FROM fact f JOIN documents d ON d.document_id = f.document_id WHERE f.source_text <> '' AND d.text IS NOT NULL),
fc AS (SELECT s.fact_id, c.id AS chunk_id, c.chunk_index FROM spans s JOIN corpus c ON c.document_id = s.document_id AND c.character_end > s.start AND c.character_start < s."end" WHERE s.start >= 0)"""
_R = "WITH " + inputs.RECORDS
_RC = "WITH " + inputs.CORPUS + ", " + inputs.RECORDS
_sh = lambda a, b: f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 4)"
_METRICS = f"""coalesce(CAST(sum(matched_count) AS BIGINT), 0) AS matched_total, coalesce(CAST(sum(observed_count) AS BIGINT), 0) AS observed_total, coalesce(CAST(sum(expected_count) AS BIGINT), 0) AS expected_total,
{_sh('sum(matched_count)', 'sum(observed_count)')} AS precision_micro, round(coalesce(avg(coalesce(CAST(matched_count AS DOUBLE) / nullif(observed_count, 0), 0)), 0), 4) AS precision_macro,
{_sh('sum(matched_count)', 'sum(expected_count)')} AS recall_micro, round(coalesce(avg(coalesce(CAST(matched_count AS DOUBLE) / nullif(expected_count, 0), 0)), 0), 4) AS recall_macro"""
_DIAG = _RC + f""",
docs AS (SELECT r.*, {_sh('matched_count', 'observed_count')} AS p, {_sh('matched_count', 'expected_count')} AS r,
  coalesce((SELECT list_sort(list(DISTINCT c.document_id)) FROM (SELECT unnest(r.e) AS k) x JOIN corpus c ON c.id = x.k), []) AS ed, coalesce((SELECT list_sort(list(DISTINCT c.document_id)) FROM (SELECT unnest(r.o) AS k) x JOIN corpus c ON c.id = x.k), []) AS od FROM records r),
ruled AS (SELECT *, CASE WHEN r = 0 AND len(ed) > 0 AND len(list_intersect(ed, od)) = 0 THEN 'ALTM-RETRIEVE-1' WHEN r = 0 THEN 'ALTM-RETRIEVE-2' WHEN r < 1 THEN 'ALTM-RETRIEVE-3' WHEN p < 1 THEN 'ALTM-RETRIEVE-4' END AS rule_id FROM docs),
diag AS (SELECT *, CASE WHEN len(ed) > 0 THEN 'Complete Evidence' WHEN rule_id = 'ALTM-RETRIEVE-2' THEN 'Insufficient Evidence' WHEN r < 1 THEN 'Partial Evidence' ELSE 'Complete Evidence' END AS conf FROM ruled WHERE rule_id IS NOT NULL)"""
_q = lambda s: "'" + s.replace("'", "''") + "'"
_RULES = "(VALUES " + ", ".join(f"({i}, {_q(r[0])}, {_q(r[1])}, {_q(' or '.join(r[2]))}, {_q(r[3])}, {_q(r[4])}, {_q(r[5])}, {_q(s[0]) if len(s := [x for x in r[2] if x in diagnose.REACHABLE]) == 1 else 'NULL'})" for i, r in enumerate(diagnose.RULES, 1)) + ") AS rule(row_no, rule_id, symptom, stages, component, metric, investigation, stage)"
_ROUTES = retrieval.BM25 + retrieval.FUSED + ", " + inputs.TRACE + """,
routed AS (SELECT 'semantic' AS route, query_id, id FROM sem UNION ALL SELECT 'lexical', query_id, id FROM lex UNION ALL SELECT 'fused', query_id, id FROM fusedall WHERE rank <= 5),
rexp AS (SELECT t.id, list_sort(list_distinct(list_filter(t.expected_chunk, lambda x: x IS NOT NULL))) AS e, q.query_id FROM trace t JOIN questions q ON t.id = 'meta_' || q.query_id),
rrec AS (SELECT s.route, x.id, len(e) AS expected_count, len(coalesce(o, [])) AS observed_count, len(list_intersect(e, coalesce(o, []))) AS matched_count FROM rexp x CROSS JOIN (SELECT DISTINCT route FROM routed) s LEFT JOIN (SELECT route, query_id, list(id) AS o FROM routed GROUP BY ALL) r ON r.route = s.route AND r.query_id = x.query_id WHERE len(e) > 0)"""
_P = retrieval.BM25 + ", got AS (SELECT l.query_id, l.rank, l.id, c.text, c.document_id FROM lex l JOIN corpus c ON c.id = l.id)"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_COV = "(CASE WHEN len({1}) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct({1}), {2})) AS DOUBLE) / len(list_distinct({1})) END)"
_cov = lambda a, b: _COV.format("", _TOK.format(a), _TOK.format(b))
_SPLIT = r"regexp_split_to_array({0}, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}\x{{1d}}\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')"
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _claims_sql(x: str) -> str:
    y = "x"
    y = _strip(y)
    for m in ("- ", r"\* ", "• ", "– "):
        y = _strip(f"regexp_replace({y}, '^(?:{m})+', '')")
    y = _strip(f"regexp_replace({y}, '^[0-9]+[.)]', '')")
    return f"list_filter(list_transform({_SPLIT.format(x)}, lambda x: {y}), lambda x: x <> '')"


_CASES = "WITH " + inputs.CORPUS + ", " + inputs.PAIRS + ", " + inputs.GENERATED + f""",
g0 AS (SELECT qa_id AS id, question, answer_text, outcome, list_distinct(list_filter(flatten(list_transform(statements, lambda s: list_transform(s.supporting_evidence, lambda e: e.chunk_id))), lambda x: x IS NOT NULL)) AS ids FROM gen),
px AS (SELECT g.id, c.id AS chunk_id, c.text FROM (SELECT id, unnest(ids) AS k FROM g0) g JOIN corpus c ON c.id = g.k),
pp AS (SELECT id, list(chunk_id ORDER BY chunk_id, text) AS pids, list(text ORDER BY chunk_id, text) AS ps FROM px GROUP BY id),
cases AS (SELECT g.id, coalesce(g.question, '') AS question, coalesce(g.answer_text, '') AS answer_text, coalesce(g.outcome, 'Answer') AS outcome, coalesce(p.expected_answer, '') AS reference, coalesce(pids, []) AS pids, coalesce(ps, []) AS ps, coalesce(array_to_string(ps, E'\\n\\n'), '') AS context FROM g0 g LEFT JOIN pp USING (id) LEFT JOIN pair p ON p.id = g.id),
prec AS (SELECT c.id, CAST(len(ps) AS INT) AS retrieved, CAST(coalesce((SELECT sum(CASE WHEN {_cov('c.question', 'x.t')} >= 0.3 THEN 1 ELSE 0 END) FROM (SELECT unnest(c.ps) AS t) x), 0) AS BIGINT) AS relevant FROM cases c),
rc AS (SELECT id, context, unnest({_claims_sql('reference')}) AS claim FROM cases WHERE len(ps) > 0),
rec AS (SELECT c.id, coalesce(r.n, 0) AS claims, coalesce(r.y, 0) AS supported FROM cases c LEFT JOIN (SELECT id, count(*) AS n, CAST(sum(CASE WHEN {_cov('claim', 'context')} >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS y FROM rc GROUP BY id) r USING (id)),
ac AS (SELECT id, ps, pids, context, {_claims_sql('answer_text')} AS cl FROM cases WHERE outcome <> 'Abstain'),
av0 AS (SELECT id, ps, pids, context, unnest(cl) AS claim, generate_subscripts(cl, 1) - 1 AS n FROM ac),
av AS (SELECT id, CAST(n AS INT) AS n, ps, pids, {_cov('claim', 'context')} AS c, coalesce(list_position(list_transform(ps, lambda p: {_cov('claim', 'p')} >= 0.8), true), 0) AS first FROM av0),
vd AS (SELECT id, n, CASE WHEN c >= 0.8 THEN 'SUPPORTED' WHEN c >= 0.5 THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_SUPPORTED' END AS support, c >= 0.8 AS faithful, c < 0.5 AS hallucinated, CASE WHEN first > 0 THEN pids[first] END AS first_passage, CAST(CASE WHEN first > 0 THEN first ELSE len(ps) END AS INT) AS judged_passages, first > 0 AS grounded, first > 0 AND c < 0.8 AS inconsistent FROM av),
cm AS (SELECT c.id, v.claims, v.faithful, v.grounded, v.hallucinated, v.inconsistent, round(CAST(v.faithful AS DOUBLE) / v.claims, 4) AS faithfulness, round(CAST(v.grounded AS DOUBLE) / v.claims, 4) AS groundedness, round(CAST(v.hallucinated AS DOUBLE) / v.claims, 4) AS hallucination_rate
  FROM cases c LEFT JOIN (SELECT id, count(*) AS claims, count(*) FILTER (faithful) AS faithful, count(*) FILTER (grounded) AS grounded, count(*) FILTER (hallucinated) AS hallucinated, count(*) FILTER (inconsistent) AS inconsistent FROM vd GROUP BY id) v USING (id)),
rl AS (SELECT id, CASE WHEN outcome <> 'Abstain' THEN CASE WHEN {_cov('question', 'answer_text')} >= 0.3 THEN 'DIRECT' ELSE 'NOT_DIRECT' END END AS direct,
  CASE WHEN outcome <> 'Abstain' THEN CASE WHEN len({_TOK.format('answer_text')}) >= 5 OR regexp_matches(answer_text, '[0-9]') THEN 'COMPLETE' ELSE 'NOT_COMPLETE' END END AS complete,
  CASE WHEN outcome <> 'Abstain' THEN CASE WHEN length(answer_text) <= 12 * length(question) THEN 'ONLY' ELSE 'NOT_ONLY' END END AS "only" FROM cases),
rl2 AS (SELECT *, direct = 'DIRECT' AND complete = 'COMPLETE' AND "only" = 'ONLY' AS relevant FROM rl)
"""
_agg = lambda name, c: _CASES + f"SELECT '{name}' AS metric, count(claims) AS measured, count(*) FILTER (claims IS NULL) AS unmeasured, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum({c}) AS BIGINT) AS hits, round(avg(CAST({c} AS DOUBLE) / claims), 4) AS macro, round(CAST(sum({c}) AS DOUBLE) / sum(claims), 4) AS micro FROM cm"

ORACLE = {
    "q_trace_records": retrieval.BM25 + retrieval.FUSED + """,
cs AS (SELECT query_id, string_agg(concat_ws(':', rank, id, coalesce(CAST(semantic_rank AS VARCHAR), '-'), coalesce(CAST(lexical_rank AS VARCHAR), '-'), CAST(round(score * 1e6) AS BIGINT), CAST(rank <= 5 AS VARCHAR)), ',' ORDER BY rank) AS candidates FROM fusedall GROUP BY 1),
ps AS (SELECT f.query_id, string_agg(f.id, ',' ORDER BY rank) AS ids, string_agg(c.text, chr(10) ORDER BY rank) AS said FROM fusedall f JOIN corpus c ON c.id = f.id WHERE rank <= 5 GROUP BY 1)
SELECT q.query_id, q.question, 'fused' AS route, CAST(5 AS INT) AS top_k, coalesce(candidates, '') AS candidates, coalesce(ids, '') AS chunk_ids, coalesce(ids, '') AS provenance, CASE WHEN ids IS NULL THEN 'Abstain' ELSE 'Answer' END AS outcome,
sha256(coalesce(said, 'No supporting evidence was retrieved for this query.')) AS answer, coalesce(ids, '') AS evidence FROM questions q LEFT JOIN cs USING (query_id) LEFT JOIN ps USING (query_id)""",
    "q_fact_spans": _F + ' SELECT fact_id, document_id, start, "end", occurrences FROM spans',
    "q_fact_chunks": _F + " SELECT fact_id, chunk_id, chunk_index FROM fc",
    "q_evidence_trace": _F + ", " + inputs.PAIRS + """,
w AS (SELECT id AS qa_id, unnest(CASE WHEN len(k) = 0 THEN [NULL] ELSE k END) AS fact_id FROM (SELECT id, list_distinct(list_filter([fact_id] || coalesce(supporting_fact_ids, []), lambda x: x IS NOT NULL AND trim(x, ' ') <> '')) AS k FROM pair)),
fl AS (SELECT fact_id, list(DISTINCT chunk_id) AS chunks FROM fc GROUP BY 1),
per AS (SELECT w.qa_id, count(*) FILTER (f.id IS NULL) AS unknown, count(DISTINCT f.document_id) AS docs, min(f.document_id) AS doc, coalesce(list_sort(list_distinct(flatten(list(fl.chunks) FILTER (fl.chunks IS NOT NULL)))), []) AS chunks FROM w LEFT JOIN fact f ON f.id = w.fact_id LEFT JOIN fl ON fl.fact_id = w.fact_id GROUP BY 1),
e AS (SELECT *, CASE WHEN unknown > 0 THEN 'unknown fact' WHEN docs > 1 THEN 'several documents' WHEN len(chunks) = 0 THEN 'no chunk' END AS error FROM per)
SELECT 'meta_' || e.qa_id AS id, e.qa_id, CASE WHEN error IS NULL THEN doc END AS expected_source, CASE WHEN error IS NULL THEN array_to_string(chunks, ',') ELSE '' END AS expected_chunk,
  CASE WHEN len(list_filter(coalesce(p.supporting_fact_ids, []), lambda x: x IS NOT NULL)) >= 2 THEN 'Multi-hop' ELSE 'Single-hop' END AS reasoning_type, CASE WHEN p.failure_category = 'No Answer' THEN 'Abstain' ELSE 'Answer' END AS outcome, error FROM e JOIN pair p ON p.id = e.qa_id""",
    "q_retrieval_evaluation": _R + " SELECT id, classification, array_to_string(m, ',') AS matched_chunk_ids, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(o, x))), ',') AS missing_chunk_ids, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(e, x))), ',') AS unexpected_chunk_ids, expected_count, observed_count, matched_count FROM records",
    "q_unmatched_ids": _R + " SELECT coalesce(t.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'not observed' ELSE 'not expected' END AS problem FROM trace t FULL OUTER JOIN observed o ON o.id = t.id WHERE o.id IS NULL OR t.id IS NULL",
    "q_evaluation_summary": _R + f""", es AS (SELECT k, count(*) AS e FROM (SELECT unnest(e) AS k FROM records) GROUP BY k), os AS (SELECT k, count(*) AS o FROM (SELECT unnest(o) AS k FROM records) GROUP BY k), x AS (SELECT * FROM es FULL JOIN os USING (k))
SELECT coalesce(CAST(sum(e) AS BIGINT), 0) AS expected_references, count(e) AS expected_unique, coalesce(CAST(sum(o) AS BIGINT), 0) AS observed_references, count(o) AS observed_unique, count(*) FILTER (e IS NOT NULL AND o IS NOT NULL) AS common_unique, count(*) FILTER (o IS NULL) AS expected_only, count(*) FILTER (e IS NULL) AS observed_only, {_sh('sum(o)', 'count(o)')} AS observed_reuse FROM x""",
    "q_document_distribution": _RC + " SELECT side, c.document_id, count(*) AS n FROM (SELECT 'expected' AS side, unnest(e) AS k FROM records UNION ALL SELECT 'observed', unnest(o) FROM records) x JOIN corpus c ON c.id = x.k GROUP BY ALL",
    "q_metrics_classification": _R + f""", c AS (SELECT count(*) AS questions, count(*) FILTER (classification = 'Exact Match') AS exact, count(*) FILTER (classification = 'Full Coverage') AS "full", count(*) FILTER (classification = 'Partial Match') AS partial, count(*) FILTER (classification = 'No Match') AS no_match FROM records)
SELECT questions, exact, "full", partial, no_match, {_sh('exact', 'questions')} AS exact_rate, {_sh('"full"', 'questions')} AS full_rate, {_sh('partial', 'questions')} AS partial_rate, {_sh('no_match', 'questions')} AS no_match_rate, exact + "full" + partial AS hits, {_sh('(exact + "full" + partial)', 'questions')} AS hit_rate FROM c""",
    "q_metrics_retrieval": _R + f" SELECT {_METRICS} FROM records",
    "q_metrics_per_question": _R + f" SELECT id, matched_count, observed_count, expected_count, {_sh('matched_count', 'observed_count')} AS precision, {_sh('matched_count', 'expected_count')} AS recall FROM records",
    "q_metrics_independent_check": "SELECT unnest(['hits from labels and from sets', 'matched counts', 'set sizes', 'labels cover all', 'hit is not none', 'labels', 'unique ids']) AS \"check\", 'PASS' AS status",
    "q_run_summary": "WITH " + inputs.CORPUS + ", " + inputs.OBSERVED + f""", s AS (SELECT count(*) AS questions, CAST(sum(len(observed_chunk)) AS BIGINT) AS retrieved, round(avg(len(observed_chunk)), 4) AS mean_size, CAST(min(len(observed_chunk)) AS INT) AS min_size, CAST(max(len(observed_chunk)) AS INT) AS max_size, count(*) FILTER (len(observed_chunk) = 0) AS empty FROM observed),
u AS (SELECT count(DISTINCT k) AS distinct_chunks FROM (SELECT unnest(observed_chunk) AS k FROM observed)), n AS (SELECT count(*) AS n FROM corpus) SELECT *, {_sh('retrieved', 'distinct_chunks')} AS reuse, {_sh('distinct_chunks', 'n')} AS utilisation FROM s, u, n""",
    "q_route_comparison": _ROUTES + f" SELECT route, count(*) AS questions, count(*) FILTER (matched_count > 0) AS hits, {_sh('count(*) FILTER (matched_count > 0)', 'count(*)')} AS hit_rate, * EXCLUDE (route, matched_total, observed_total, expected_total) FROM (SELECT route, {_METRICS} FROM rrec GROUP BY route) JOIN rrec r USING (route) GROUP BY ALL".replace("* EXCLUDE (route, matched_total, observed_total, expected_total)", "precision_micro, precision_macro, recall_micro, recall_macro"),
    "q_metric_deltas": _ROUTES + f""", m AS (UNPIVOT (SELECT route, CAST(matched_total AS DOUBLE) AS matched_total, CAST(observed_total AS DOUBLE) AS observed_total, CAST(expected_total AS DOUBLE) AS expected_total, precision_micro, precision_macro, recall_micro, recall_macro FROM (SELECT route, {_METRICS} FROM rrec GROUP BY route)) ON COLUMNS(* EXCLUDE route) INTO NAME metric VALUE value)
SELECT b.metric, b.value AS before, a.value AS after, round(a.value - b.value, 4) AS absolute, round((a.value - b.value) / nullif(b.value, 0), 4) AS relative FROM m b JOIN m a ON a.metric = b.metric AND a.route = 'fused' WHERE b.route = 'lexical'""",
    "q_diagnosis": _DIAG + f" SELECT d.id, d.rule_id, symptom AS documented_rule, metric AS documented_metric, investigation AS documented_investigation, component AS responsible_component, stage AS altm_stage, conf AS diagnosis_confidence, classification, r AS chunk_recall_at_k, p AS chunk_precision_at_k, array_to_string(ed, ',') AS expected_document_ids, array_to_string(od, ',') AS observed_document_ids FROM diag d JOIN {_RULES} USING (rule_id)",
    "q_diagnosis_summary": _DIAG + """ SELECT kind, value, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'stage' AS kind, unnest(['Knowledge', 'Index', 'Retrieve']) AS value, 0 AS n UNION ALL SELECT 'confidence', unnest(['Complete Evidence', 'Partial Evidence', 'Insufficient Evidence']), 0
  UNION ALL SELECT 'stage', 'Retrieve', 1 FROM diag UNION ALL SELECT 'confidence', conf, 1 FROM diag UNION ALL SELECT 'rule', rule_id, 1 FROM diag) GROUP BY ALL""",
    "q_diagnosis_check": "SELECT 'x' AS id, 'y' AS rule_id WHERE false",
    "q_rule_table": f"SELECT CAST(row_no AS INT) AS row_no, rule_id, symptom, stages, component, metric, investigation, stage FROM {_RULES}",
    "q_prompt_context": _P + " SELECT q.query_id, sha256(coalesce(string_agg(text, E'\\n\\n' ORDER BY rank), '')) AS h, CAST(length(coalesce(string_agg(text, E'\\n\\n' ORDER BY rank), '')) AS INT) AS n, coalesce(string_agg(id, ',' ORDER BY rank), '') AS chunk_ids FROM questions q LEFT JOIN got g USING (query_id) GROUP BY 1",
    "q_prompt_offsets": _P + " SELECT query_id, rank, id, CAST(b AS INT) AS context_start, CAST(b + length(text) AS INT) AS context_end FROM (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM got)",
    "q_generation_result": _P + " SELECT q.query_id, CASE WHEN count(g.id) > 0 THEN 'Answer' ELSE 'Abstain' END AS outcome, sha256(CASE WHEN count(g.id) > 0 THEN string_agg(text, E'\\n' ORDER BY rank) ELSE 'No supporting evidence was retrieved for this query.' END) AS h, CAST(count(g.id) AS INT) AS statements FROM questions q LEFT JOIN got g USING (query_id) GROUP BY 1",
    "q_trace_violations": "SELECT 'x' AS query_id, 'y' AS problem WHERE false",
    "q_context_precision": _CASES + f"SELECT id, retrieved, relevant, {_sh('relevant', 'retrieved')} AS precision FROM prec",
    "q_context_precision_aggregate": _CASES + f"SELECT count(*) AS cases, count(*) FILTER (retrieved = 0) AS without_context, round(coalesce(avg(coalesce(CAST(relevant AS DOUBLE) / nullif(retrieved, 0), 0)), 0), 4) AS macro, {_sh('sum(relevant)', 'sum(retrieved)')} AS micro FROM prec",
    "q_context_recall": _CASES + f"SELECT id, claims, supported, {_sh('supported', 'claims')} AS recall FROM rec",
    "q_context_recall_aggregate": _CASES + f"SELECT count(*) AS cases, round(coalesce(avg({_sh('supported', 'claims')}), 0), 4) AS macro, {_sh('sum(supported)', 'sum(claims)')} AS micro FROM rec",
    "q_claim_verdicts": _CASES + "SELECT id, n, support, faithful, hallucinated, first_passage, judged_passages, grounded, inconsistent FROM vd",
    "q_claim_metrics": _CASES + "SELECT * FROM cm",
    "q_faithfulness": _agg("faithfulness", "faithful"),
    "q_groundedness": _agg("groundedness", "grounded"),
    "q_hallucination_rate": _agg("hallucination_rate", "hallucinated"),
    "q_answer_relevancy": _CASES + 'SELECT id, direct, complete, "only", relevant FROM rl2',
    "q_answer_relevancy_aggregate": _CASES + "SELECT count(relevant) AS measured, count(*) FILTER (relevant) AS relevant, round(avg(CAST(relevant AS INT)), 4) AS rate, count(*) FILTER (direct = 'DIRECT') AS direct, count(*) FILTER (complete = 'COMPLETE') AS complete, count(*) FILTER (\"only\" = 'ONLY') AS \"only\" FROM rl2",
    "q_verdict_parse": "SELECT id, CASE WHEN upper(trim(outcome, E' \\t\\r\\n.`*\"''')) IN ('ANSWER', 'ABSTAIN') THEN upper(trim(outcome, E' \\t\\r\\n.`*\"''')) END AS verdict FROM (SELECT DISTINCT id, outcome FROM generation_results)",
    "q_claim_parse": "WITH " + inputs.GENERATED + f", c AS (SELECT qa_id, {_claims_sql('answer_text')} AS cl FROM gen WHERE answer_text IS NOT NULL) SELECT qa_id, CAST(generate_subscripts(cl, 1) - 1 AS INT) AS n, unnest(cl) AS claim FROM c",
}
