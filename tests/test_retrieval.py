"""Hand-computed cases of retrieval: tokens, BM25, chunks, vectors, fusion."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.ids import chunk_id, document_id, placeholder_embedding
from corpusloom.functions.text import claims, normal_text, tokens, verdict
from corpusloom.operators import chunking, fusion, lexical, vectors
from corpusloom.plans import retrieval


def corpus(spark, texts):
    return spark.createDataFrame([(f"c{i}", t, 1, "s", i) for i, t in enumerate(texts)], "id string, text string, canon int, source string, chunk_index int")


def asked(spark, *questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, question string")


def top(spark, texts, question, k=5):
    return [(r.id, r.score) for r in lexical.bm25(corpus(spark, texts), asked(spark, question), k).orderBy("rank").collect()]


def by_hand(texts, question):
    docs = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = []
    for i, d in enumerate(docs):
        tf = Counter(d)
        terms = [w for w in sorted(re.findall("[a-z0-9]+", question.lower())) if tf[w]]
        if terms:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / avg)) for w in terms)
            out.append((f"c{i}", round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("k", [1, 3, 5, 50])
def test_bm25_is_the_formula(spark, k):
    texts = ["alpha beta", "alpha", "alpha alpha gamma", "delta", "", "beta gamma delta epsilon", "the the the alpha", "zeta the", "the beta", None]
    question = "the alpha BETA zeta beta!"
    assert top(spark, texts, question, k) == [(i, pytest.approx(s, abs=2e-6)) for i, s in by_hand([t or "" for t in texts], question)[:k]]


def test_bm25_rare_terms_lead_and_ties_go_by_place(spark):
    assert top(spark, ["alpha"] * 4 + ["beta"], "alpha beta")[0][0] == "c4"
    assert [i for i, _ in top(spark, ["x y", "x y", "x y"], "x")] == ["c0", "c1", "c2"]


def test_questions_do_not_pass_through_the_driver(spark):
    # Only the numbers of the corpus's blocks are broadcast; the questions are sent to the blocks by a shuffle.
    found = lexical.bm25(corpus(spark, ["alpha beta", "beta"]), asked(spark, "alpha", "beta"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" in plan


def test_diagnostics_and_fusion_do_not_pass_through_the_driver(spark):
    # Broadcast are the numbers of the corpus's blocks, once a search, and the one row of statistics.
    c, q = corpus(spark, ["alpha beta", "beta"]).withColumn("document_id", F.lit("d")), asked(spark, "alpha", "beta")
    found = lexical.bm25(c, q, 3)
    plan = lexical.diagnostics(found, c, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("BroadcastNestedLoopJoin") == 1
    assert "Broadcast" not in fusion.fused_candidates(q.select("query_id", F.lit("c0").alias("id"), F.lit(1).alias("rank")), q.select("query_id", F.lit("c1").alias("id"), F.lit(1).alias("rank")), c)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,k,most", [(70, 5, 3), (5000, 5, 40), (5000, 1, 10**15), (3000, 46, 10**9), (4096, 5, 0)])
def test_best_of_a_block(n, k, most):
    rng, block = np.random.default_rng(n + k), object.__new__(lexical._Postings)
    units = np.zeros(-(-n // lexical._GROUP) * lexical._GROUP, np.int64)
    units[:n] = rng.integers(0, most + 1, n) * 499_999
    want = sorted(((-((int(u) + 500_000) // 1_000_000), i) for i, u in enumerate(units) if u))[:k]
    assert [(-int(s), int(i)) for i, s in zip(*block.best(units, k))] == want


@pytest.mark.parametrize("question", ["", "?!", "unknown"])
def test_no_candidates(spark, question):
    assert top(spark, ["alpha"], question) == []
    assert top(spark, ["alpha"], "alpha", 0) == []


def test_matched_counts(spark):
    got = lexical.matched_counts(corpus(spark, ["a b", "a", "c"]), asked(spark, "a b", "z")).orderBy("query_id").collect()
    assert [r.candidates_matched for r in got] == [2, 0] and got[1].best_score == 0.0


def test_chunks(spark):
    assert chunking.chunk_spans("") == [] == chunking.chunk_spans(" \n\n ")
    assert chunking.chunk_spans("one") == [(0, 3)]
    assert [("a\n \nb c")[a:b] for a, b in chunking.chunk_spans("a\n \nb c")] == ["a", "b c"]
    long = "word " * 500
    spans = chunking.chunk_spans(long)
    assert all(0 < b - a <= 1000 for a, b in spans) and "".join(long[a:b] for a, b in spans).replace(" ", "") == long.replace(" ", "")
    assert chunking.chunk_spans("x" * 2500) == [(0, 1000), (1000, 2000), (2000, 2500)]
    df = spark.createDataFrame([("d1", "a\n\nb"), ("d2", None), ("d3", "")], "document_id string, text string")
    got = chunking.chunk(df).orderBy("chunk_index").collect()
    assert [(r.document_id, r.text, r.chunk_index, r.character_start, r.character_end) for r in got] == [("d1", "a", 0, 0, 1), ("d1", "b", 1, 3, 4)]
    assert chunking.reconstruction_failures(chunking.chunk(df), df).count() == 0


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, normal_text, " a \r\nb\t\r\r\n\n\nc ") == "a\nb\n\nc"
    assert one(spark, tokens, "It's A-1, é") == ["it", "s", "a", "1"] and one(spark, tokens, None) == []
    assert one(spark, lambda c: verdict(c, ("SUPPORTED", "NOT_SUPPORTED")), " `supported.`\n") == "SUPPORTED"
    assert one(spark, lambda c: verdict(c, ("SUPPORTED",)), "NOT_SUPPORTED") is None
    assert one(spark, claims, "- one\n\n2. two\r\n* - three\n") == ["one", "two", "- three"] or one(spark, claims, "- one\n\n2. two\r\n* three\n") == ["one", "two", "three"]


def test_identifiers(spark):
    import hashlib

    assert one(spark, document_id, "a/b.docx") == hashlib.sha256(b"a/b.docx").hexdigest()[:12]
    assert one(spark, lambda c: chunk_id(c, F.lit(3)), "d") == hashlib.sha256(b"d:3").hexdigest()[:16]
    d = hashlib.sha256("x".encode()).digest()
    assert one(spark, placeholder_embedding, "x") == [int.from_bytes(d[2 * i : 2 * i + 2], "big") / 65536 for i in range(16)]


def route(spark, *ids):
    return spark.createDataFrame([("q", i, n) for n, i in enumerate(ids, 1)], "query_id string, id string, rank int")


def test_fusion(spark):
    rows = fusion.reciprocal_rank_fusion(route(spark, "A", "B", "C"), route(spark, "C", "A", "D"), k=9).orderBy("rank").collect()
    assert [r.id for r in rows] == ["A", "C", "B", "D"] and rows[0].score == round(1 / 61 + 1 / 62, 6)
    assert rows[3].semantic_rank is None and rows[2].lexical_rank is None
    empty = route(spark, "A").limit(0)
    assert [r.id for r in fusion.reciprocal_rank_fusion(empty, route(spark, "X", "Y"), k=5).orderBy("rank").collect()] == ["X", "Y"]
    assert fusion.reciprocal_rank_fusion(empty, empty).count() == 0 == fusion.reciprocal_rank_fusion(route(spark, "A"), empty, k=0).count()
    assert [r.id for r in fusion.reciprocal_rank_fusion(route(spark, "A", "B", "A"), empty, k=5).orderBy("rank").collect()] == ["A", "B"]


def test_nearest(spark):
    c = spark.createDataFrame([("s", f"i{i}", [float(i), 1.0]) for i in range(6)] + [("other", "z", [99.0])], "space string, id string, v array<double>")
    q = spark.createDataFrame([("s", "q", [1.0, 0.0])], c.schema)
    got = vectors.nearest_of(q, c, 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("i5", 5.0), ("i4", 4.0), ("i3", 3.0)]
    assert vectors.nearest_of(q, c, 0).count() == 0 and vectors.nearest_of(q, c, 50).count() == 6 and vectors.nearest_of(q, c.limit(0), 3).count() == 0


def test_query_vectors_do_not_pass_through_the_driver(spark, tmp_path):
    spark.createDataFrame([("s", f"i{i}", [float(i), 1.0]) for i in range(6)], "space string, id string, v array<double>").write.parquet(str(tmp_path / "v"))
    c = spark.read.parquet(str(tmp_path / "v"))
    assert "SortMergeJoin" in vectors.nearest_of(c.limit(2), c, 3)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,k,levels", [(900, 5, 10**6), (900, 5, 3), (901, 1, 50), (100, 5, 9), (640, 0, 9)])
def test_best_products(n, k, levels):
    rng = np.random.default_rng(n + k)
    q, c = rng.integers(0, levels, (7, 3)) / levels, rng.integers(0, levels, (n, 3)) / levels
    c[n // 2] = np.nan if n == 901 else 0
    rows, at, score = vectors._best(q, c, k, 6)
    for r in range(7):
        of = np.flatnonzero(rows == r)
        want = np.argsort(-np.round(q[r] @ c.T, 6), kind="stable")[:k]
        got = of[np.argsort(-score[of], kind="stable")][:k]
        assert at[got].tolist() == want.tolist()


def test_embeddings_are_searched_in_full(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=4).astype(np.float32) for i in range(130)}
    spark.createDataFrame([(i, x.tolist()) for i, x in rows.items()], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in retrieval.QUERIES["q_embedding_top5"](spark, str(tmp_path)).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    scores = {q: {i: round(float(rows[q].astype(float) @ x.astype(float)), 6) for i, x in rows.items()} for q in range(0, 130, 20)}
    assert got == {q: sorted(s, key=lambda i: (-s[i], i))[:5] for q, s in scores.items()}


def test_fingerprint_ignores_order(spark):
    rows = [("a", "x"), ("b", None), ("c", "y")]
    f = lambda r, n: vectors.corpus_fingerprint(spark.createDataFrame(r, "id string, text string").repartition(n), "id", "text").first().fingerprint
    assert f(rows, 1) == f(rows[::-1], 3) != f([("a", "x"), ("b", None), ("c", "z")], 1)
