"""Evaluation, diagnosis and judged metrics: exhaustive labels, paired derivations, corrupted records."""

from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assemble, diagnose, evaluate, golden, judged, quality
from corpusloom.plans import evaluation
from tests.conftest import SF

UNIVERSE = ["a", "b", "c"]
SETS = [list(s) for s in chain.from_iterable(combinations(UNIVERSE, n) for n in range(4))]


def records(spark, rows=None):
    rows = rows or [(f"{''.join(e)}/{''.join(o)}", e, o) for e in SETS if e for o in SETS]
    expected = spark.createDataFrame([(i, e) for i, e, _ in rows], "id string, expected_chunk array<string>")
    observed = spark.createDataFrame([(i, o) for i, _, o in rows], "id string, observed_chunk array<string>")
    return evaluate.evaluation_records(expected, observed)


def test_every_pair_of_sets_has_its_label(spark):
    for r in records(spark).collect():
        e, o = (set(x) for x in r.id.split("/"))
        want = "Exact Match" if e == o else "Full Coverage" if e < o else "Partial Match" if e & o else "No Match"
        assert r.classification == want, r.id
        assert set(r.matched_chunk_ids) == e & o and set(r.missing_chunk_ids) == e - o and set(r.unexpected_chunk_ids) == o - e


def test_metrics_by_hand(spark):
    r = records(spark, [("q1", ["a", "b"], ["a", "x", "y"]), ("q2", ["c"], ["c"]), ("q3", ["d"], []), ("q4", [], ["z"]), ("q5", ["a", None, "a"], None)])
    m = evaluate.retrieval_metrics(r).first()
    assert (m.matched_total, m.observed_total, m.expected_total) == (2, 4, 5)
    assert (m.precision_micro, m.recall_micro) == (0.5, 0.4)
    assert m.precision_macro == round((1 / 3 + 1) / 4, 4) and m.recall_macro == round(1.5 / 4, 4)
    c = evaluate.classification_counts(r).first()
    assert (c.exact, c.full, c.partial, c.no_match, c.hits, c.hit_rate) == (1, 0, 1, 2, 2, 0.5)
    empty = evaluate.retrieval_metrics(r.limit(0)).first()
    assert empty.precision_micro == 0.0 == empty.recall_macro


def test_second_derivation_agrees_and_notices_corruption(spark):
    r = records(spark)
    status = lambda x: {c.check: c.status for c in evaluate.independent_check(x).collect()}
    assert set(status(r).values()) == {"PASS"}
    bad = r.withColumn("classification", F.when(F.col("id") == "a/a", "No Match").otherwise(F.col("classification")))
    assert status(bad)["labels"] == status(bad)["hits from labels and from sets"] == "FAIL"
    assert status(r.withColumn("matched_count", F.col("matched_count") + 1))["matched counts"] == "FAIL"
    assert status(r.unionByName(r.limit(1)))["unique ids"] == "FAIL"


def test_unmatched_ids(spark):
    e = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    o = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {(r.id, r.problem) for r in evaluate.unmatched_ids(e, o).collect()} == {("a", "not observed"), ("b", "repeated"), ("c", "not expected")}


def test_deltas(spark):
    m = lambda **v: spark.createDataFrame(list(v.items()), "metric string, value double")
    got = {r.metric: (r.absolute, r.relative) for r in evaluate.metric_deltas(m(x=0.5, zero=0.0, gone=1.0), m(x=0.75, zero=0.25)).collect()}
    assert got == {"x": (0.25, 0.5), "zero": (0.25, None)}


def test_rules(spark):
    rows = [("r1", 0.0, 0.0, ["d"], ["e"]), ("r1b", 0.0, 0.0, ["d"], []), ("r2", 0.0, 0.0, ["d"], ["d"]), ("r2b", 0.0, 0.0, [], ["d"]), ("r3", 0.5, 1.0, [], []), ("r4", 1.0, 0.5, [], []), ("ok", 1.0, 1.0, [], [])]
    df = spark.createDataFrame(rows, "id string, recall double, precision double, expected_document_ids array<string>, observed_document_ids array<string>")
    rec = df.drop("recall", "precision").withColumns({"classification": F.lit("x"), "expected_count": F.lit(1), "observed_count": F.lit(1), "matched_count": F.lit(1)})
    found = diagnose.diagnoses(rec, df)
    got = {r.id: (r.rule_id[-1], r.diagnosis_confidence.split()[0], r.altm_stage) for r in found.collect()}
    assert got == {"r1": ("1", "Complete", "Retrieve"), "r1b": ("1", "Complete", "Retrieve"), "r2": ("2", "Complete", "Retrieve"), "r2b": ("2", "Insufficient", "Retrieve"), "r3": ("3", "Partial", "Retrieve"), "r4": ("4", "Complete", "Retrieve")}
    again = diagnose.second_derivation(rec, df)
    assert found.select("id", "rule_id").exceptAll(again).count() == 0 == again.exceptAll(found.select("id", "rule_id")).count()
    summary = {(r.kind, r.value): r.n for r in diagnose.diagnosis_summary(found).collect()}
    assert summary["stage", "Index"] == 0 and summary["rule", "ALTM-RETRIEVE-1"] == 2


def cases(spark, rows):
    return spark.createDataFrame(rows, "id string, question string, answer_text string, outcome string, reference string, passages array<struct<id:string,text:string>>")


def test_judged_metrics(spark):
    c = cases(spark, [
        ("both", "who founded it", "ann founded it in 2011", "Answer", "ann founded it", [("p1", "ann founded it"), ("p2", "it began in 2011")]),
        ("none", "q", "x y z", "Answer", "w", [("p1", "nothing")]),
        ("abstain", "q", "no", "Abstain", "w", []),
    ])
    v = {r.id: r for r in judged.claim_verdicts(c).collect()}
    assert v["both"].support == "SUPPORTED" and not v["both"].grounded and v["both"].judged_passages == 2
    assert v["none"].hallucinated and "abstain" not in v
    per = judged.claim_metrics(c, judged.claim_verdicts(c))
    agg = judged.claim_aggregate(per, "faithfulness", "faithful").first()
    assert (agg.measured, agg.unmeasured, agg.macro, agg.micro) == (2, 1, 0.5, 0.5)
    assert judged.claim_aggregate(per.where("id = 'abstain'"), "f", "faithful").first().macro is None
    p = {r.id: r for r in judged.context_precision(c).collect()}
    assert p["abstain"].precision == 0.0 and p["abstain"].retrieved == 0
    r = {x.id: x for x in judged.context_recall(c).collect()}
    assert (r["both"].recall, r["none"].recall, r["abstain"].claims) == (1.0, 0.0, 0)
    assert {x.id: x.relevant for x in judged.relevancy(c).collect()}["abstain"] is None


def test_relevancy_parse(spark):
    read = lambda t: spark.createDataFrame([(t,)], "t string").select(judged.parsed_relevancy(F.col("t")).alias("x")).first().x
    assert read("DIRECT\n\n`complete`\nNOT_ONLY.")["only"] == "NOT_ONLY"
    assert read("DIRECT\nCOMPLETE") is None and read("COMPLETE\nDIRECT\nONLY") is None and read("DIRECT\nCOMPLETE\nONLY\nONLY") is None


def test_selection(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert judged.selected(df, "a").count() == 1 and judged.selected(df, everything=True).count() == 2
    for bad in ({}, {"case_id": "z"}):
        with pytest.raises(ValueError):
            judged.selected(df, **bad)


def test_prompts_and_answers(spark):
    q = spark.createDataFrame([("q1", "?"), ("q2", "?")], "query_id string, question string")
    chunks = spark.createDataFrame([("c1", "d", "one\n\ntwo", 0, 8), ("c2", "d", "three", 8, 13)], "id string, document_id string, text string, character_start int, character_end int")
    got = spark.createDataFrame([("q1", 1, "c2"), ("q1", 2, "c1"), ("q1", 3, "gone")], "query_id string, rank int, id string")
    passages = assemble.resolved(got, chunks)
    assert [r.id for r in assemble.unresolved(got, chunks).collect()] == ["gone"]
    p = {r.query_id: r for r in assemble.prompts(q, passages).collect()}
    assert p["q1"].context == "three\n\none\n\ntwo" and p["q2"].context == "" and p["q1"].provenance[1].character_end == 8
    offsets = assemble.passage_offsets(passages)
    for r in offsets.collect():
        assert p["q1"].context[r.context_start : r.context_end] == {"c1": "one\n\ntwo", "c2": "three"}[r.id]
    assert assemble.inconsistent_prompts(assemble.prompts(q, passages), offsets).count() == 0
    a = {r.query_id: r for r in assemble.answers(q, passages).collect()}
    assert a["q2"].outcome == "Abstain" and a["q2"].statements == [] and a["q1"].answer_text == "three\none\n\ntwo"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passages_do_not_pass_through_the_driver(spark, tmp_path):
    def small(name, *made):  # of known size
        spark.createDataFrame(*made).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    q = small("q", [("q1", "?")], "query_id string, question string")
    chunks = small("chunks", [("c1", "d", "one", 0, 3)], "id string, document_id string, text string, character_start int, character_end int")
    candidates = small("candidates", [("q1", 1, "c1", 1, 1, 0.5)], "query_id string, rank int, id string, semantic_rank int, lexical_rank int, score double")
    passages = assemble.resolved(candidates, chunks)
    p, a = assemble.prompts(q, passages), assemble.answers(q, passages)
    for df in (passages, p, a, assemble.traces(q, candidates, p, a, 1)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_rows_of_questions_do_not_pass_through_the_driver(spark):
    # Broadcast are the seven metrics.
    said = plan(evaluation.q_metric_deltas(spark, SF))
    assert said.count("BroadcastHashJoin") == 1 and "BroadcastNestedLoopJoin" not in said and "SortMergeJoin" in said


def test_golden(spark):
    facts = spark.createDataFrame([("f1", "d", "bb"), ("f2", "d", "zz"), ("f3", "e", "cc"), ("f4", "d", None)], "id string, document_id string, source_text string")
    docs = spark.createDataFrame([("d", "aabbaabb"), ("e", "cc")], "document_id string, text string")
    spans = golden.fact_spans(facts, docs)
    assert {(r.fact_id, r.start, r.end, r.occurrences) for r in spans.collect()} == {("f1", 2, 4, 2), ("f2", -1, -1, 0), ("f3", 0, 2, 1)}
    chunks = spark.createDataFrame([("c1", "d", 0, 2, 0), ("c2", "d", 2, 3, 1), ("c3", "d", 3, 8, 2), ("c4", "e", 0, 2, 0)], "id string, document_id string, character_start int, character_end int, chunk_index int")
    located = golden.fact_chunks(spans, chunks)
    assert {(r.fact_id, r.chunk_id) for r in located.collect()} == {("f1", "c2"), ("f1", "c3"), ("f3", "c4")}
    pairs = spark.createDataFrame([("q1", "f1", [], None), ("q2", "f1", ["f3"], None), ("q3", "f9", None, "No Answer"), ("q4", "f2", [None], None), ("q5", None, ["f1", "f1"], None)], "id string, fact_id string, supporting_fact_ids array<string>, failure_category string")
    got = {r.qa_id: r for r in golden.evidence_trace(pairs, facts, located).collect()}
    assert got["q1"].expected_chunk == ["c2", "c3"] and got["q1"].reasoning_type == "Single-hop"
    assert [got[q].error for q in ("q2", "q3", "q4", "q5")] == ["several documents", "unknown fact", "no chunk", None]
    assert got["q3"].outcome == "Abstain" and got["q5"].reasoning_type == "Multi-hop"


def test_quality(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("b", " "), ("c", "y\n")], "id string, v string")
    assert [r.key for r in quality.duplicates(rows, "id", "dup").collect()] == ["a"]
    assert sorted(r.key for r in quality.missing_fields(rows, "id", {"v": "^[a-z]$"}, "f").collect()) == ["a", "b", "c"]
    parents = spark.createDataFrame([("x",)], "k string")
    orphans = quality.orphan_keys(rows, "id", "v", parents, "k", "o")
    assert sorted(r.key for r in orphans.collect()) == ["b", "c"]
    report = {r.check: (r.status, r.violations) for r in quality.report([orphans], ["o", "other"]).collect()}
    assert report == {"o": ("FAIL", 2), "other": ("PASS", 0)}
    with pytest.raises(ValueError):
        quality.passed(orphans)
    quality.passed(orphans.limit(0))
