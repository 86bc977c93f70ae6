"""Gates, second derivations, prompts, reports, provider responses and the model seam on small frames."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assemble, diagnose, evaluate, gates, lexical, prompts, reports, vectors

RECORD = "id string, classification string, expected_chunk_ids array<string>, observed_chunk_ids array<string>, matched_chunk_ids array<string>, expected_count int, observed_count int, matched_count int, extra int"


def problems(df):
    return sorted((r.id, r.problem) for r in df.collect())


def test_record_gate(spark):
    good = ("a", "Partial Match", ["x", "y"], ["x"], ["x"], 2, 1, 1, 0)
    rows = [good, ("b", "Best Match", ["x"], ["x"], ["x"], 1, 1, 1, 0), ("c", "No Match", [], [], [], 0, 0, 0, 0), ("d", "No Match", ["x"], ["y"], [], 2, 1, 0, 0), ("e", "No Match", ["x"], None, [], 1, None, 0, 0), ("f", *good[1:]), ("f", *good[1:]), (None, *good[1:])]
    got = problems(gates.record_problems(spark.createDataFrame(rows, RECORD)).withColumn("id", F.coalesce("id", F.lit("-"))))
    assert got == sorted([("b", "classification"), ("c", "nothing expected"), ("d", "expected_count"), ("e", "observed_count"), ("f", "repeated"), ("f", "repeated"), ("-", "id")])
    assert problems(gates.record_problems(spark.createDataFrame([], RECORD))) == []


def judged_records(spark):
    expected = spark.createDataFrame([("q1", ["c1", "c2"]), ("q2", ["c3"]), ("q3", ["c1"])], "id string, expected_chunk array<string>")
    observed = spark.createDataFrame([("q1", ["c1"]), ("q2", ["c9"]), ("q3", ["c1"])], "id string, observed_chunk array<string>")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("c3", "d2"), ("c9", "d3")], "id string, document_id string")
    return evaluate.with_documents(evaluate.evaluation_records(expected, observed), chunks)


def test_diagnosis_gate_and_checks(spark):
    r = judged_records(spark)
    m = evaluate.question_metrics(r)
    found = diagnose.diagnoses(r, m)
    assert {x.id: x.rule_id for x in found.collect()} == {"q1": "ALTM-RETRIEVE-3", "q2": "ALTM-RETRIEVE-1"}
    assert problems(gates.diagnosis_problems(found, r)) == []
    none = {c: 0 for c in gates.DIAGNOSIS_CHECKS}
    assert {x.check: x.violations for x in gates.diagnosis_checks(found, r, m).collect()} == none
    wrong = found.withColumn("rule_id", F.lit("ALTM-NONE-9")).withColumn("diagnosis_confidence", F.lit("Sure")).unionByName(found.where("id = 'q1'").withColumn("id", F.lit("q7")))
    got = problems(gates.diagnosis_problems(wrong, r))
    assert ("q1", "rule") in got and ("q2", "confidence") in got and ("q7", "unknown question") in got
    checks = {x.check: x.violations for x in gates.diagnosis_checks(wrong, r, m).collect()}
    assert checks["paired"] == 1 and checks["rule"] == 2 and checks["confidence"] == 2 and checks["evidence"] == 0
    lost = m.where("id <> 'q2'").unionByName(m.where("id = 'q1'").withColumn("id", F.lit("q8")))
    assert problems(gates.unpaired(r, lost)) == [("q2", "no metrics"), ("q8", "no record")]


def test_ratios_are_derived_again(spark):
    r = judged_records(spark)
    m, whole = evaluate.question_metrics(r), evaluate.retrieval_metrics(r)
    assert problems(gates.ratio_problems(r, m, whole)) == []
    off = m.withColumn("recall", F.when(F.col("id") == "q1", 0.6).otherwise(F.col("recall")))
    assert problems(gates.ratio_problems(r, off, whole.withColumn("recall_macro", F.lit(0.9)))) == [("q1", "question ratio"), ("recall_macro", "ratio of the whole")]


def test_case_gates(spark):
    schema = "id string, question string, reference string, answer_text string, outcome string, passages array<struct<id:string,text:string>>"
    p = [("c", "text")]
    rows = [("ok", "q?", "r", "a", "Answer", p), ("abstains", "q?", "r", "none", "Abstain", []), ("bare", "q?", "r", "a", "Answer", []), ("blank", " 　", " ", "", "Maybe", [("c", " \n")]), ("nulls", None, None, None, None, None)]
    cases = spark.createDataFrame(rows, schema)
    assert problems(gates.context_case_problems(cases)) == sorted([("blank", "question"), ("blank", "reference"), ("blank", "passage"), ("nulls", "question"), ("nulls", "reference"), ("nulls", "passage")])
    got = problems(gates.generation_case_problems(cases.drop("reference")))
    assert got == sorted([("bare", "no context"), *(("blank", x) for x in ("question", "answer", "outcome", "passage")), *(("nulls", x) for x in ("question", "answer", "outcome", "no context", "passage"))])
    with pytest.raises(ValueError, match="expected_answer"):
        gates.generation_case_problems(cases.withColumn("expected_answer", F.lit("x")))


def test_provider_responses(spark):
    rows = [(200, '{"choices":[{"message":{"content":"Zelt."}}]}'), (200, '{"choices":[{"message":{"content":""}}]}'), (200, '{"choices":[{"message":{"content":7}}]}'), (200, '{"choices":[{}]}'), (200, '{"choices":[]}'), (200, "<html>"), (401, "{}"), (429, "{}"), (503, None), (None, None), (200, None), (302, "{}")]
    df = spark.createDataFrame(rows, "status int, body string").withColumn("x", gates.response_text(F.col("status"), F.col("body"))).select("x.*")
    assert [(r.text, r.error) for r in df.collect()] == [("Zelt.", None), *((None, e) for e in ("no content", "no content", "no message", "no choices", "not JSON", "not authorised", "rate limited", "provider failed", "no response", "not JSON", "unexpected status"))]


def test_a_model_is_asked_only_with_evidence(spark):
    queries = spark.createDataFrame([("q1", "Which tool?"), ("q2", "Who?"), ("q3", "When?")], "query_id string, question string")
    passages = spark.createDataFrame([("q1", 1, "c1", "d1", "Zelt it was.", 0, 12), ("q3", 1, "c2", "d1", "Never.", 0, 6)], "query_id string, rank int, id string, document_id string, text string, character_start int, character_end int")
    asked = []
    model = lambda q, c: (asked.append(1), F.when(q != "When?", F.concat(c, F.lit("!"))))[1]
    got = {r.query_id: r for r in gates.model_answers(queries, assemble.prompts(queries, passages), model, assemble.ABSTENTION).collect()}
    assert got["q1"].answer_text == "Zelt it was.!" and got["q1"].outcome == "Answer" and [e.chunk_id for e in got["q1"].evidence] == ["c1"]
    assert got["q2"].answer_text == assemble.ABSTENTION and got["q2"].outcome == "Abstain" and not got["q2"].evidence
    assert got["q3"].outcome is None and asked == [1]


def test_contexts_do_not_pass_through_the_driver(spark, tmp_path):
    q = spark.createDataFrame([("q1", "one")], "query_id string, question string")
    assembled = spark.createDataFrame([("q1", "text", [("c1",)])], "query_id string, context string, provenance array<struct<chunk_id:string>>")
    assembled.write.parquet(str(tmp_path / "a"))  # of known size
    assembled = spark.read.parquet(str(tmp_path / "a"))
    said = gates.model_answers(q, assembled, lambda question, context: question, "none")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in said and "Broadcast" not in said


def test_prompts_take_their_arguments_only(spark):
    df = spark.createDataFrame([("Who?", "Amon.")], "q string, p string")
    assert "Who?" in df.select(prompts.prompt("relevance", question=F.col("q"), passage=F.col("p"))).first()[0]
    for wrong in ({"question": F.col("q")}, {"question": F.col("q"), "passage": F.col("p"), "reference": F.col("p")}):
        with pytest.raises(ValueError):
            prompts.prompt("relevance", **wrong)


def test_report_lines(spark):
    df = spark.createDataFrame([("b", 0.5, None), ("a", None, 3)], "name string, value double, n int")
    got = [r.line for r in reports.lines(df, {"name": 4, "value": 7, "n": 3}, ["name"]).orderBy("n").collect()]
    assert got == ["name    value    n", "-" * 18, "a           -    3", "b      0.5000    -"]


def test_fingerprint_is_a_tree(spark):
    rows = [(f"c{i}", f"t{i}") for i in range(40)] + [("c1", "t1"), ("n", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    one = vectors.corpus_fingerprint(df, "id", "text", 3).first()
    assert one.rows == 42 and one == vectors.corpus_fingerprint(df.orderBy(F.rand()), "id", "text", 3).first()
    for changed in (rows[1:], [*rows, rows[0]], [("c0", "T0"), *rows[1:]]):
        assert vectors.corpus_fingerprint(spark.createDataFrame(changed, "id string, text string"), "id", "text", 3).first().fingerprint != one.fingerprint
    assert vectors.corpus_fingerprint(df.limit(0), "id", "text").first().rows == 0


def test_bm25_over_many_blocks(spark, monkeypatch):
    import math
    import random

    rng = random.Random(2)
    words = [f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(6000)]
    texts = [" ".join(words[i : i + rng.randrange(0, 30)]) for i in range(0, 6000, 15)] + ["", "w1"]
    corpus = spark.createDataFrame([(f"c{i:03d}", t, i % 2, "s", i if i % 5 else None) for i, t in enumerate(texts)], "id string, text string, canon int, source string, chunk_index int")
    asked = [("q1", "w0 W1, w2 w9 w9"), ("q2", "w50"), ("q3", "none such"), ("q4", "")]
    queries = spark.createDataFrame(asked, "query_id string, question string")
    split = [t.split() for t in texts]
    n, avg = len(texts), sum(map(len, split)) / len(texts)

    def score(q, d):
        s = 0.0
        for w in lexical_tokens(q):
            df = sum(w in x for x in split)
            tf = d.count(w)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg)) if tf else 0
        return round(s, 6)

    def lexical_tokens(q):
        import re

        return re.findall("[a-z0-9]+", q.lower())

    for block in (7, 8192):
        monkeypatch.setattr(lexical, "BLOCK", block)
        got = {}
        for r in lexical.bm25(corpus.repartition(3), queries, 4).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, r.score, " ".join(r.matched_terms)))
        for q, text in asked:
            order = sorted(((-score(text, d), i % 2, i if i % 5 else -1, f"c{i:03d}", i) for i, d in enumerate(split) if score(text, d) > 0))[:4]
            assert sorted(got.get(q, [])) == [(k, c, -s, " ".join(sorted(set(lexical_tokens(text)) & set(split[i])))) for k, (s, _, _, c, i) in enumerate(order, 1)]
    assert lexical.bm25(corpus, queries, 0).count() == 0 and lexical.bm25(corpus.limit(0), queries, 3).count() == 0 and lexical.bm25(corpus, queries.limit(0), 3).count() == 0
