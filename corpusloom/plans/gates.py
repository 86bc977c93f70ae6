"""Queries on gates, second derivations, partitions and diagnostics, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import assemble, diagnose, evaluate, gates, judged, lexical, prompts, reports
from corpusloom.plans import evaluation, inputs, retrieval
from corpusloom.plans.evaluation import _CASES, _DIAG, _METRICS, _R, _sh, _strip
from corpusloom.runtime import stage


def q_record_gate(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records that may not be measured: none."""
    return gates.record_problems(evaluation._records(spark, d))


def q_expectation_gate(spark: SparkSession, d: str) -> DataFrame:
    """The trace as delivered, read as records that observed just what they expect: blank and repeated ids show."""
    e = F.coalesce("expected_chunk", F.array().cast("array<string>"))
    kept = F.array_distinct(F.filter(e, lambda x: x.isNotNull()))
    rows = inputs.expectations(spark, d).select(
        "id", F.lit("Exact Match").alias("classification"), kept.alias("expected_chunk_ids"), kept.alias("observed_chunk_ids"), kept.alias("matched_chunk_ids"),
        F.size(e).alias("expected_count"), F.size(e).alias("observed_count"), F.size(e).alias("matched_count"),
    )
    return gates.record_problems(rows)


def q_diagnosis_gate(spark: SparkSession, d: str) -> DataFrame:
    """Diagnoses that are not valid: those of rules without a single stage in reach."""
    r, m = evaluation._diagnosed(spark, d)
    return gates.diagnosis_problems(diagnose.diagnoses(r, m), r)


def q_diagnosis_checks(spark: SparkSession, d: str) -> DataFrame:
    """The eight checks of the second derivation with their violations."""
    r, m = evaluation._diagnosed(spark, d)
    return gates.diagnosis_checks(diagnose.diagnoses(r, m), r, m)


def q_ratio_check(spark: SparkSession, d: str) -> DataFrame:
    """Published ratios that are not what the ids give: none."""
    r = stage(evaluation._records(spark, d), "records")
    return gates.ratio_problems(r, evaluate.question_metrics(r), evaluate.retrieval_metrics(r))


def q_context_gate(spark: SparkSession, d: str) -> DataFrame:
    """Cases of the context metrics that may not be judged."""
    return gates.context_case_problems(evaluation._cases(spark, d))


def q_generation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Cases of the generation metrics that may not be judged."""
    return gates.generation_case_problems(evaluation._cases(spark, d).select("id", "question", "answer_text", "outcome", "passages"))


def q_answer_partition(spark: SparkSession, d: str) -> DataFrame:
    """Context metrics over all cases, and again over those whose expected outcome is an answer."""
    cases = stage(evaluation._cases(spark, d), "cases")
    due = inputs.expectations(spark, d).where("expected_outcome = 'Answer'").select(F.regexp_replace("id", "^meta_", "").alias("id"))
    rows = []
    for name, part in (("all", cases), ("Answer", cases.join(due, "id", "left_semi"))):
        p, r = judged.precision_aggregate(judged.context_precision(part)), judged.recall_aggregate(judged.context_recall(part))
        rows.append(p.select(F.lit(name).alias("partition"), "cases", F.col("macro").alias("precision_macro"), F.col("micro").alias("precision_micro")).join(r.select(F.col("macro").alias("recall_macro"), F.col("micro").alias("recall_micro"))))
    return rows[0].unionByName(rows[1])


def q_retrieval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Every question's record of its lexical retrieval; the filters asked for are reported, not applied."""
    corpus, queries = stage(inputs.corpus(spark, d), "corpus"), stage(inputs.questions(spark, d), "questions")
    found = lexical.bm25(corpus, queries, retrieval.K)
    return lexical.diagnostics(found, corpus, queries, retrieval.K, {"top_k": retrieval.K, "subject": "x", "language": "en"})


def q_model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a scripted model, which is asked only where there is evidence."""
    queries, _, passages = evaluation._prompted(spark, d)
    scripted = lambda q, c: F.concat(F.lit("On "), q, F.lit(": "), F.left(c, F.lit(80)))
    x = gates.model_answers(queries, assemble.prompts(queries, passages), scripted, assemble.ABSTENTION)
    return x.select("query_id", "outcome", F.sha2("answer_text", 256).alias("h"), F.size("evidence").alias("evidence"))


def q_judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompts over every judged case: question and answer, question and first passage, answer and context."""
    c = evaluation._cases(spark, d).withColumn("context", F.array_join(F.transform("passages", lambda p: p["text"]), "\n\n")).withColumn("passage", F.try_element_at("passages", F.lit(1))["text"])
    given = {"question": F.col("question"), "answer": F.col("answer_text"), "claim": F.col("answer_text"), "context": F.col("context"), "passage": F.coalesce("passage", F.lit("")), "reference": F.col("reference")}
    said = {n: prompts.prompt(n, **{a: given[a] for a in re.findall(r"\{(\w+)\}", t)}) for n, t in prompts.TEMPLATES.items()}
    return c.select("id", *(F.sha2(x, 256).alias(n) for n, x in said.items()))


def q_metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval metrics as a text report."""
    long = evaluate.as_metrics(evaluate.retrieval_metrics(evaluation._records(spark, d)))
    return reports.lines(long.select("metric", F.col("value").cast("double").alias("value")), {"metric": 20, "value": 14}, ["metric"])


QUERIES = {
    f.__name__: f
    for f in (q_judge_prompts, q_metrics_report, q_record_gate, q_expectation_gate, q_diagnosis_gate, q_diagnosis_checks, q_ratio_check, q_context_gate, q_generation_gate, q_answer_partition, q_retrieval_diagnostics, q_model_answers)
}


def _failed(tests: dict[str, str], rest: str, key: str = "id") -> str:
    bad = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in tests.items())
    return f" SELECT id, problem FROM (SELECT CAST({key} AS VARCHAR) AS id, unnest([{bad}]) AS problem FROM {rest}) WHERE problem IS NOT NULL"


_filled = lambda x: f"coalesce({_strip(x)} <> '', false)"
_WHOLE = "len(list_filter(list_zip(pids, ps), lambda p: NOT ({0} AND {1}))) = 0".format(_filled("p[1]"), _filled("p[2]"))
_KEPT = "len(list_distinct(list_filter(coalesce(expected_chunk, []), lambda x: x IS NOT NULL))) = len(coalesce(expected_chunk, []))"
_PART = """SELECT '{0}' AS partition, (SELECT count(*) FROM prec WHERE {1}) AS cases, (SELECT round(coalesce(avg(coalesce(CAST(relevant AS DOUBLE) / nullif(retrieved, 0), 0)), 0), 4) FROM prec WHERE {1}) AS precision_macro,
(SELECT {2} FROM prec WHERE {1}) AS precision_micro, (SELECT round(coalesce(avg({3}), 0), 4) FROM rec WHERE {1}) AS recall_macro, (SELECT {4} FROM rec WHERE {1}) AS recall_micro"""
_ratios = (_sh("sum(relevant)", "sum(retrieved)"), _sh("supported", "claims"), _sh("sum(supported)", "sum(claims)"))

_GIVEN = {"question": "question", "answer": "answer_text", "claim": "answer_text", "context": "array_to_string(ps, chr(10) || chr(10))", "passage": "coalesce(ps[1], '')", "reference": "reference"}
_said = lambda t: " || ".join((_GIVEN[x] if i % 2 else "'" + x.replace("'", "''") + "'") for i, x in enumerate(re.split(r"\{(\w+)\}", t)) if x)

ORACLE = {
    "q_judge_prompts": _CASES + " SELECT id, " + ", ".join(f"sha256({_said(t)}) AS {n}" for n, t in prompts.TEMPLATES.items()) + " FROM cases",
    "q_metrics_report": _R + f""", w AS (SELECT {_METRICS} FROM records),
v AS (SELECT unnest(['matched_total', 'observed_total', 'expected_total', 'precision_micro', 'precision_macro', 'recall_micro', 'recall_macro']) AS metric, unnest([CAST(matched_total AS DOUBLE), observed_total, expected_total, precision_micro, precision_macro, recall_micro, recall_macro]) AS value FROM w)
SELECT CAST(-1 AS INT) AS n, rpad('metric', 20, ' ') || '  ' || lpad('value', 14, ' ') AS line UNION ALL SELECT 0, repeat('-', 36) UNION ALL SELECT CAST(row_number() OVER (ORDER BY metric) AS INT), rpad(metric, 20, ' ') || '  ' || lpad(printf('%.4f', value), 14, ' ') FROM v""",
    "q_record_gate": _R + _failed({"id": _filled("id"), "nothing expected": "len(e) > 0", "classification": "classification IS NOT NULL", "expected_count": "expected_count = len(e)", "observed_count": "observed_count = len(o)", "matched_count": "matched_count = len(m)"}, "records"),
    "q_expectation_gate": "WITH " + inputs.TRACE + _failed({"id": _filled("id"), "expected_count": _KEPT, "observed_count": _KEPT, "matched_count": _KEPT, "nothing expected": "len(coalesce(expected_chunk, [])) > 0"}, "trace"),
    "q_diagnosis_gate": _DIAG + " SELECT d.id, p.problem FROM diag d JOIN (SELECT rule_id, stage FROM " + evaluation._RULES + ") u ON u.rule_id = d.rule_id CROSS JOIN (SELECT unnest(['stage', 'stage of rule']) AS problem) p WHERE u.stage IS NULL",
    "q_diagnosis_checks": "SELECT unnest([" + ", ".join(f"'{c}'" for c in gates.DIAGNOSIS_CHECKS) + ']) AS "check", CAST(0 AS BIGINT) AS violations',
    "q_ratio_check": _R + f", whole AS (SELECT {_METRICS} FROM records) SELECT id, 'question ratio' AS problem FROM records WHERE round(matched_count / nullif(observed_count, 0), 4) <> {_sh('len(m)', 'len(o)')} UNION ALL SELECT 'whole', 'ratio of the whole' FROM whole WHERE precision_micro IS NULL",
    "q_context_gate": _CASES + _failed({"id": _filled("id"), "question": _filled("question"), "reference": _filled("reference"), "passage": _WHOLE}, "cases"),
    "q_generation_gate": _CASES + _failed({"id": _filled("id"), "question": _filled("question"), "answer": _filled("answer_text"), "outcome": "outcome IN ('Answer', 'Abstain')", "no context": "outcome = 'Abstain' OR len(ps) > 0", "passage": _WHOLE}, "cases"),
    "q_answer_partition": _CASES + ", " + inputs.TRACE + ", due AS (SELECT regexp_replace(id, '^meta_', '') AS id FROM trace WHERE expected_outcome = 'Answer') " + " UNION ALL ".join(_PART.format(n, w, *_ratios) for n, w in (("all", "true"), ("Answer", "id IN (SELECT id FROM due)"))),
    "q_retrieval_diagnostics": retrieval.BM25
    + """, got AS (SELECT l.query_id, string_agg(l.id, ',' ORDER BY rank) AS ids, string_agg(coalesce(c.document_id, ''), ',' ORDER BY rank) AS docs, string_agg(CAST(l.score AS VARCHAR), ',' ORDER BY rank) AS scores, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranking, string_agg(matched_terms, ',' ORDER BY rank) AS terms FROM lex l JOIN corpus c ON c.id = l.id GROUP BY 1)
SELECT q.query_id, q.question AS query, array_to_string(list_sort(regexp_extract_all(lower(q.question), '[a-z0-9]+')), ' ') AS query_terms, coalesce(ids, '') AS retrieved_chunk_ids, coalesce(docs, '') AS document_ids, coalesce(scores, '') AS scores, coalesce(ranking, '') AS ranking, coalesce(terms, '') AS matched_terms,
'lexical' AS retrieval_method, 1.2::DOUBLE AS bm25_k1, 0.75::DOUBLE AS bm25_b, round(avgdl, 6) AS average_document_length, CAST(5 AS INT) AS top_k, (SELECT count(*) FROM scored s WHERE s.query_id = q.query_id) AS candidates_matched, n AS corpus_size, false AS sql_filter_applied, 'language,subject' AS filters_ignored
FROM questions q LEFT JOIN got g USING (query_id) CROSS JOIN st""",
    "q_model_answers": evaluation._P + """, ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM got GROUP BY 1)
SELECT q.query_id, CASE WHEN n > 0 THEN 'Answer' ELSE 'Abstain' END AS outcome, sha256(CASE WHEN n > 0 THEN 'On ' || question || ': ' || left(context, 80) ELSE 'No supporting evidence was retrieved for this query.' END) AS h, CAST(coalesce(n, 0) AS INT) AS evidence FROM questions q LEFT JOIN ctx USING (query_id)""",
}
