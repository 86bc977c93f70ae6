"""Gates: rows that may not enter a step, as frames (id, problem), empty if all may; and a strict reading of a model's response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.diagnose import CONFIDENCES, REACHABLE, rule_table, selected_rule
from corpusloom.operators.evaluate import LABELS

# Fields that a judged generation case may not carry, and the outcomes it may have.
BARRED_CASE_FIELDS = ("statements", "supporting_evidence", "expected_answer", "reference_answer", "expected_chunk", "expected_metrics")
OUTCOMES = ("Answer", "Abstain")


def _problems(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """(id, problem): a row for every test that a row fails; a test that is null fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items())))
    return rows.select(F.col(key).cast("string").alias("id"), F.explode(failed).alias("problem"))


def _once(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(key)))


def blank(c: str | Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) == "", F.lit(True))


def record_problems(records: DataFrame) -> DataFrame:
    """Evaluation records that metrics may not be taken of: a missing or repeated id, an unknown label, counts that
    are not those of the ids, and nothing expected. Further columns do no harm."""
    counts = {f"{c}_count": F.col(f"{c}_count") == F.size(f"{c}_chunk_ids") for c in ("expected", "observed", "matched")}
    tests = {"id": ~blank("id"), "repeated": F.col("_times") == 1, "classification": F.col("classification").isin(*LABELS), **counts, "nothing expected": F.col("expected_count") > 0}
    return _problems(_once(records, "id"), "id", tests)


def unpaired(records: DataFrame, metrics: DataFrame) -> DataFrame:
    """(id, problem): records without metrics and metrics without record, which would be lost in their join."""
    side = lambda x, y, name: x.select("id").join(y.select("id"), "id", "left_anti").select("id", F.lit(name).alias("problem"))
    return side(records, metrics, "no metrics").unionByName(side(metrics, records, "no record"))


def diagnosis_problems(found: DataFrame, records: DataFrame) -> DataFrame:
    """Diagnoses that are not valid: an undocumented rule, a stage out of reach or not the rule's, an unknown
    confidence, a symptom that is not the rule's, a question that was not evaluated or is diagnosed twice."""
    rules = rule_table(found.sparkSession).select("rule_id", "symptom", "stages")
    known = records.select("id", F.lit(True).alias("known")).distinct()
    # The rule table has 13 rows.
    x = _once(found, "id").join(F.broadcast(rules), "rule_id", "left").join(known, "id", "left")
    tests = {
        "rule": F.col("symptom").isNotNull(), "stage": F.col("altm_stage").isin(*REACHABLE), "stage of rule": F.array_contains("stages", F.col("altm_stage")), "confidence": F.col("diagnosis_confidence").isin(*CONFIDENCES),
        "rule text": F.col("documented_rule") == F.col("symptom"), "unknown question": F.col("known"), "repeated": F.col("_times") == 1,
    }
    return _problems(x, "id", tests)


# The checks of the diagnosis report, in order.
DIAGNOSIS_CHECKS = ("paired", "symptomatic diagnosed", "healthy undiagnosed", "rule", "rule cells", "stage", "confidence", "evidence")


def diagnosis_checks(found: DataFrame, records: DataFrame, metrics: DataFrame) -> DataFrame:
    """(check, violations): a second derivation of the diagnoses held against them, by what can be wrong."""
    m = metrics.select("id", F.col("precision").alias("p"), F.col("recall").alias("r"))
    cells = ("rule_id", "documented_rule", "documented_metric", "documented_investigation", "responsible_component", "altm_stage", "diagnosis_confidence", "chunk_recall_at_k", "chunk_precision_at_k")
    said = found.select("id", *cells, *(F.col(c).alias(f"said_{c}") for c in ("expected_count", "observed_count", "matched_count")), F.lit(True).alias("diagnosed"))
    x = records.join(m, "id").join(said, "id", "left")
    e, o = "expected_document_ids", "observed_document_ids"
    due = selected_rule(F.col("r"), F.col("p"), F.col(e), F.col(o))
    rules = rule_table(found.sparkSession).select(F.col("rule_id").alias("due"), *(F.col(c).alias(f"rule_{c}") for c in ("symptom", "metric", "investigation", "component", "stage")))
    x = x.withColumn("due", due).join(F.broadcast(rules), "due", "left")
    same = lambda pairs: F.forall(F.array(*(F.col(a).eqNullSafe(F.col(b)) for a, b in pairs)), lambda y: y)
    whole = (F.size(e) > 0) | ((F.col("due") != "ALTM-RETRIEVE-2") & (F.col("r") >= 1))
    confidence = F.when(whole, CONFIDENCES[0]).when(F.col("due") == "ALTM-RETRIEVE-2", CONFIDENCES[2]).otherwise(CONFIDENCES[1])
    told, is_due = F.col("diagnosed").isNotNull(), F.col("due").isNotNull()
    bad = {
        "symptomatic diagnosed": is_due & ~told, "healthy undiagnosed": ~is_due & told, "rule": told & is_due & (F.col("rule_id") != F.col("due")),
        "rule cells": told & is_due & ~same([("documented_rule", "rule_symptom"), ("documented_metric", "rule_metric"), ("documented_investigation", "rule_investigation"), ("responsible_component", "rule_component")]),
        "stage": told & is_due & ~F.col("altm_stage").eqNullSafe(F.col("rule_stage")), "confidence": told & is_due & (F.col("diagnosis_confidence") != confidence),
        "evidence": told & ~same([("said_expected_count", "expected_count"), ("said_observed_count", "observed_count"), ("said_matched_count", "matched_count"), ("chunk_recall_at_k", "r"), ("chunk_precision_at_k", "p")]),
    }
    lost = unpaired(records, metrics).unionByName(found.select("id").join(records, "id", "left_anti").select("id", F.lit("no record").alias("problem")))
    counted = x.agg(*(F.count_if(c).alias(name) for name, c in bad.items())).join(lost.agg(F.count("*").alias("paired")))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in DIAGNOSIS_CHECKS))).alias("x")).select("x.*")


def ratio_problems(records: DataFrame, metrics: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, problem): published ratios, of questions and (under the metric's name) of the whole, that are not what
    the ids give. Ids are counted anew; questions are averaged unrounded."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = {c: F.size(F.array_distinct(f"{c}_chunk_ids")) for c in ("expected", "observed")}
    hit = F.size(F.array_intersect("expected_chunk_ids", "observed_chunk_ids"))
    mine = records.select("id", hit.alias("m"), n["expected"].alias("e"), n["observed"].alias("o"), ratio(hit, n["observed"]).alias("p"), ratio(hit, n["expected"]).alias("r"))
    each = mine.join(metrics.select("id", "precision", "recall"), "id").where((F.round("p", 4) != F.col("precision")) | (F.round("r", 4) != F.col("recall")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = mine.agg(F.round(zero(ratio(F.sum("m"), F.sum("o"))), 4).alias("x_precision_micro"), F.round(zero(ratio(F.sum("m"), F.sum("e"))), 4).alias("x_recall_micro"), F.round(zero(F.avg("p")), 4).alias("x_precision_macro"), F.round(zero(F.avg("r")), 4).alias("x_recall_macro"))
    names = ("precision_micro", "recall_micro", "precision_macro", "recall_macro")
    off = whole.join(sums).select(F.explode(F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"x_{c}")), F.lit(c)) for c in names)))).alias("id"))
    return each.select("id", F.lit("question ratio").alias("problem")).unionByName(off.select("id", F.lit("ratio of the whole").alias("problem")))


def context_case_problems(cases: DataFrame) -> DataFrame:
    """Cases of the context metrics (id, question, reference, passages) that may not be judged."""
    passages = ~F.exists("passages", lambda p: blank(p["id"]) | blank(p["text"]))
    return _problems(_once(cases, "id"), "id", {"id": ~blank("id"), "repeated": F.col("_times") == 1, "question": ~blank("question"), "reference": ~blank("reference"), "passage": passages})


def generation_case_problems(cases: DataFrame) -> DataFrame:
    """Cases of the generation metrics (id, question, answer_text, outcome, passages) that may not be judged.

    An answer must have passages, an abstention need not. Columns that would let a judge see ground truth or the
    answer's own evidence are refused, whatever they hold.
    """
    barred = [c for c in cases.columns if c.lower() in BARRED_CASE_FIELDS]
    if barred:
        raise ValueError(f"a case may not carry {', '.join(sorted(barred))}")
    answers = F.col("outcome") != "Abstain"
    return _problems(_once(cases, "id"), "id", {
        "id": ~blank("id"), "repeated": F.col("_times") == 1, "question": ~blank("question"), "answer": ~blank("answer_text"), "outcome": F.col("outcome").isin(*OUTCOMES),
        "no context": ~answers | (F.size("passages") > 0), "passage": ~F.exists("passages", lambda p: blank(p["id"]) | blank(p["text"])),
    })


def response_text(status: Column, body: Column) -> Column:
    """Struct (text, error) of a chat provider's response: the first choice's message, or why there is none.

    Only status 200 is read; the body must be JSON with a non-empty list of choices whose first has a message with
    a non-empty string as its content. One response gives one reading, nothing is tried again.
    """
    whole = F.try_parse_json(body)
    content = F.try_variant_get(whole, "$.choices[0].message.content", "string")
    kind = F.schema_of_variant(F.try_variant_get(whole, "$.choices[0].message.content", "variant"))
    error = (
        F.when(status.isNull(), "no response").when(status.isin(401, 403), "not authorised").when(status == 402, "no balance").when(status.isin(400, 422), "request refused").when(status == 429, "rate limited").when(status >= 500, "provider failed").when(status != 200, "unexpected status")
        .when(whole.isNull(), "not JSON").when(F.try_variant_get(whole, "$.choices[0]", "variant").isNull(), "no choices").when(F.try_variant_get(whole, "$.choices[0].message", "variant").isNull(), "no message")
        .when(content.isNull() | (kind != "STRING") | (content == ""), "no content")
    )
    return F.struct(F.when(error.isNull(), content).alias("text"), error.alias("error"))


def model_answers(queries: DataFrame, assembled: DataFrame, model: Callable[[Column, Column], Column], abstention: str) -> DataFrame:
    """(query_id, answer_text, outcome, evidence): answers of a model that is called only where there is evidence.

    ``assembled`` is what prompts() gives. The evidence of an answer is the prompt's provenance, taken before the
    model speaks. ``model`` maps question and context to a text column (a pandas UDF; mark it non-deterministic so
    that it runs once a row); it is never given a question without context. A null or blank answer is an error,
    left as outcome null.
    """
    x = queries.select("query_id", "question").join(assembled.select("query_id", "context", F.col("provenance").alias("evidence")).hint("merge"), "query_id", "left")
    some = F.coalesce(F.size("evidence") > 0, F.lit(False))
    asked = x.where(some).withColumn("answer_text", model(F.col("question"), F.col("context")))
    said = asked.select("query_id", "answer_text", F.when(~blank("answer_text"), "Answer").alias("outcome"), "evidence")
    none = x.where(~some).select("query_id", F.lit(abstention).alias("answer_text"), F.lit("Abstain").alias("outcome"), F.slice("evidence", 1, 0).alias("evidence"))
    return said.unionByName(none)
