"""Rule-based diagnosis of evaluated questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules in document order (id, symptom, stages, component, metric, what to look at).
RULES = (
    ("ALTM-INFER-1", "Hallucinated fact not in any source document", ("Infer",), "Generator", "Faithfulness, Hallucination Rate", "Check assembled prompt for the claim; if absent, it's fabricated at Infer"),
    ("ALTM-KNOWLEDGE-1", "Answer cites the wrong document version", ("Knowledge",), "Knowledge Source", "Freshness check", "Compare corpus hash/timestamp against the source of record"),
    ("ALTM-RETRIEVE-1", "Right topic, wrong specific document retrieved", ("Retrieve",), "Retriever", "Context Precision", "Inspect ranked candidates for the query"),
    ("ALTM-RETRIEVE-2", "Missing answer despite evidence existing in the corpus", ("Retrieve", "Assemble"), "Retriever / Context Builder", "Context Recall", "Check whether evidence was retrieved at all vs. retrieved-but-dropped"),
    ("ALTM-INDEX-1", "Contradictory answer across repeated runs on the same input", ("Index", "Infer"), "Indexer / Generator", "Chunk coverage; determinism check", "Confirm indexing is stable before suspecting generation non-determinism"),
    ("ALTM-KNOWLEDGE-2", "Stale answer despite a recent source update", ("Knowledge",), "Knowledge Source", "Freshness check", "Verify re-indexing was triggered on the source change"),
    ("ALTM-RETRIEVE-3", "Low recall on a known-answerable query", ("Retrieve",), "Retriever", "Context Recall", "Check ranking cutoff (top-k) and query formulation"),
    ("ALTM-RETRIEVE-4", "Low precision on a known-answerable query", ("Retrieve",), "Retriever", "Context Precision", "Check for near-duplicate or loosely-related chunks crowding results"),
    ("ALTM-INFER-2", "False confidence on an unanswerable question", ("Infer", "Final Answer"), "Generator / Evaluation Engine", "Hallucination Rate; abstention check", 'Confirm the "No Answer" failure-taxonomy category is represented in the Golden Dataset'),
    ("ALTM-ASSEMBLE-1", "Correct evidence retrieved, answer still wrong", ("Assemble", "Infer"), "Context Builder / Generator", "Prompt assembly tests; Faithfulness", "Diff the assembled prompt against the retrieved chunk set before suspecting the model"),
    ("ALTM-POST-PROCESS-1", "Answer correct pre-guardrail, wrong as delivered", ("Post-Process",), "Generator (guardrail layer)", "Guardrail/output-contract tests", "Compare pre- and post-processing output directly"),
    ("ALTM-EVALUATE-1", "Regression after a prompt or corpus change, previously passing", ("Evaluate",), "Evaluation Engine", "Promptfoo diff", "Re-run the regression suite against the last known-good baseline"),
    ("ALTM-FINAL-ANSWER-1", "Faithful, grounded, but doesn't answer the actual question", ("Final Answer",), "Evaluation Engine", "Answer Relevancy", "Re-check the query against a task-specific rubric, not against truthfulness metrics"),
)
REACHABLE = ("Knowledge", "Index", "Retrieve")
CONFIDENCES = ("Complete Evidence", "Partial Evidence", "Insufficient Evidence")


def rule_table(spark: SparkSession) -> DataFrame:
    """(row_no, rule_id, symptom, stages, component, metric, investigation, stage): the 13 rules; ``stage`` is a
    rule's one reachable stage, null where it has none or several."""
    rows = [(i, *r, next(iter(s)) if len(s := [x for x in r[2] if x in REACHABLE]) == 1 else None) for i, r in enumerate(RULES, 1)]
    return spark.createDataFrame(rows, "row_no int, rule_id string, symptom string, stages array<string>, component string, metric string, investigation string, stage string")


def selected_rule(recall: Column, precision: Column, expected: Column, observed: Column) -> Column:
    """The first rule that applies to a question's rounded metrics and document sets, or null."""
    apart = (F.size(expected) > 0) & (F.size(F.array_intersect(expected, observed)) == 0)
    return F.when((recall == 0) & apart, "ALTM-RETRIEVE-1").when(recall == 0, "ALTM-RETRIEVE-2").when(recall < 1, "ALTM-RETRIEVE-3").when(precision < 1, "ALTM-RETRIEVE-4")


def confidence(rule: Column, recall: Column, expected: Column) -> Column:
    """How complete the evidence behind a diagnosis is."""
    return F.when(F.size(expected) > 0, CONFIDENCES[0]).when(rule == "ALTM-RETRIEVE-2", CONFIDENCES[2]).when(recall < 1, CONFIDENCES[1]).otherwise(CONFIDENCES[0])


def diagnoses(records: DataFrame, metrics: DataFrame) -> DataFrame:
    """One diagnosis per question with a symptom, with the rule's own cells and the evidence it rests on.

    Records and metrics must be of the same questions: ``gates.unpaired`` gives those that are not, which this join
    would lose.
    """
    x = records.join(metrics.select("id", "precision", "recall"), "id")
    rule = selected_rule(F.col("recall"), F.col("precision"), F.col("expected_document_ids"), F.col("observed_document_ids"))
    x = x.withColumn("rule_id", rule).where("rule_id IS NOT NULL")
    # The rule table has 13 rows.
    x = x.join(F.broadcast(rule_table(records.sparkSession)), "rule_id")
    return x.select(
        "id", "rule_id", F.col("symptom").alias("documented_rule"), F.col("metric").alias("documented_metric"), F.col("investigation").alias("documented_investigation"), F.col("component").alias("responsible_component"), F.col("stage").alias("altm_stage"),
        confidence(F.col("rule_id"), F.col("recall"), F.col("expected_document_ids")).alias("diagnosis_confidence"), "classification", "expected_count", "observed_count", "matched_count", F.col("recall").alias("chunk_recall_at_k"), F.col("precision").alias("chunk_precision_at_k"), "expected_document_ids", "observed_document_ids",
    )


def diagnosis_summary(found: DataFrame) -> DataFrame:
    """(kind, value, n): diagnoses by stage and confidence (all values, also at zero) and by rule (as they occur)."""
    spark = found.sparkSession
    domain = spark.createDataFrame([("stage", s) for s in REACHABLE] + [("confidence", c) for c in CONFIDENCES], "kind string, value string")
    counted = found.select(F.explode(F.array(F.struct(F.lit("stage").alias("kind"), F.col("altm_stage").alias("value")), F.struct(F.lit("confidence").alias("kind"), F.col("diagnosis_confidence").alias("value")), F.struct(F.lit("rule").alias("kind"), F.col("rule_id").alias("value")))).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    filled = domain.join(counted, ["kind", "value"], "left").select("kind", "value", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(counted.where("kind = 'rule'"))


def second_derivation(records: DataFrame, metrics: DataFrame) -> DataFrame:
    """(id, rule_id): diagnoses again, by enumerating every rule that matches and taking the first in rule order."""
    x = records.join(metrics.select("id", "precision", "recall"), "id")
    e, o = "expected_document_ids", "observed_document_ids"
    cases = {
        3: (F.col("recall") == 0) & (F.size(e) > 0) & ~F.arrays_overlap(e, o),
        4: F.col("recall") == 0,
        7: (F.col("recall") < 1),
        8: (F.col("precision") < 1),
    }
    hits = F.array_min(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in cases.items())), lambda n: n.isNotNull()))
    return x.select("id", hits.alias("row_no")).join(F.broadcast(rule_table(records.sparkSession)), "row_no").select("id", "rule_id")
