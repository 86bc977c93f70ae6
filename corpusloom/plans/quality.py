"""Data-quality queries: corpus (dq), golden data (gd, qa, et) and checks across tables (x)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import quality as op
from corpusloom.plans import inputs
from corpusloom.plans.evaluation import q_fact_chunks
from corpusloom.runtime import table


def q_dq_hash_freshness(spark: SparkSession, d: str) -> DataFrame:
    return op.stale_hashes(inputs.manifest(spark, d), inputs.documents(spark, d), "dq1")


def q_dq_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids delivered in several rows, per table."""
    names = ("manifest", "chunks", "resume_facts", "resume_qa_pairs", "resume_evidence_trace", "generation_results")
    found = [op.duplicates(table(spark, d, n), "id", n) for n in names]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def q_dq_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Documents without manifest entry, and entries without document."""
    docs, entries = table(spark, d, "documents").select("document_id"), inputs.manifest(spark, d).select(F.col("id").alias("document_id"))
    side = lambda x, y, c: op.violations(x.join(y, "document_id", "left_anti"), c, "document_id", F.lit("none"))
    return side(docs, entries, "no entry").unionByName(side(entries, docs, "no document"))


def q_dq_unchunked(spark: SparkSession, d: str) -> DataFrame:
    return op.childless(inputs.documents(spark, d).where("text <> ''"), "document_id", inputs.corpus(spark, d), "document_id", "dq4")


def q_dq_chunk_contract(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that break the contract of their fields or the length their offsets give."""
    c = table(spark, d, "chunks").where("deleted_at IS NULL").select("id", "document_id", "text", "chunk_index", "character_start", "character_end").distinct()
    fields = op.missing_fields(c, "id", {"id": "^[0-9a-f]{16}$", "document_id": "^[0-9a-f]{12}$", "text": "", "chunk_index": "^[0-9]+$", "character_start": "^[0-9]+$", "character_end": "^[0-9]+$"}, "fields")
    length = op.violations(c.where(F.length("text") != F.col("character_end") - F.col("character_start")), "length", "id", F.length("text") - F.col("character_end") + F.col("character_start"))
    return fields.unionByName(length)


def q_dq_chunk_orphans(spark: SparkSession, d: str) -> DataFrame:
    return op.orphan_keys(inputs.corpus(spark, d), "id", "document_id", table(spark, d, "documents"), "document_id", "dq6")


def q_dq_manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest").select("id", "source", "hash", "canonical", "manifest_version").distinct()
    return op.missing_fields(rows, "id", {"id": "^[0-9a-f]{12}$", "source": "", "hash": "^[0-9a-f]{64}$", "canonical": "", "manifest_version": r"^1\.0$"}, "manifest")


def q_gd_fields(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "resume_facts").select("id", "source", "document_id", "document_source", "section", "fact", "source_text").distinct()
    return op.missing_fields(f, "id", {"id": "^[a-z]+_f[0-9]+$", "source": "", "document_id": "^[0-9a-f]{12}$", "document_source": "", "section": "", "fact": "", "source_text": ""}, "gd")


def q_gd_verbatim(spark: SparkSession, d: str) -> DataFrame:
    return op.not_verbatim(inputs.facts(spark, d), inputs.documents(spark, d), "gd_verbatim")


def q_qa_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "resume_qa_pairs").select("id", "source", "fact_id", "fact_relation", "question", "question_category", "expected_answer", "answerable").distinct()
    return op.missing_fields(p, "id", {"id": "^qa_[a-z]+_f[0-9]+_[a-z]+_[0-9]+$", "source": "", "fact_id": "^[a-z]+_f[0-9]+$", "fact_relation": "^(supports|bounds|refutes)$", "question": "", "question_category": "^(reasoning|lexical|semantic|summarization)$", "expected_answer": "", "answerable": ""}, "qa")


def q_et_fields(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "resume_evidence_trace").select("id", "question", "expected_answer", "expected_source", "expected_reasoning_type", "expected_outcome").distinct()
    return op.missing_fields(t, "id", {"id": "^meta_qa_", "question": "", "expected_answer": "", "expected_source": "^[0-9a-f]{12}$", "expected_reasoning_type": "^(Single-hop|Multi-hop)$", "expected_outcome": "^(Answer|Abstain)$"}, "et")


def q_x_fact_fk(spark: SparkSession, d: str) -> DataFrame:
    return op.orphan_keys(inputs.pairs(spark, d), "id", "fact_id", table(spark, d, "resume_facts"), "id", "x1")


def q_x_supporting_fk(spark: SparkSession, d: str) -> DataFrame:
    return op.orphan_keys(inputs.pairs(spark, d), "id", "supporting_fact_ids", table(spark, d, "resume_facts"), "id", "x2")


def q_x_empty_evidence(spark: SparkSession, d: str) -> DataFrame:
    t = inputs.expectations(spark, d)
    return op.violations(t.where((F.coalesce(F.size("expected_chunk"), F.lit(0)) == 0) | F.col("expected_chunk").isNull()), "x3", "id", F.lit("empty"))


def q_x_single_document(spark: SparkSession, d: str) -> DataFrame:
    """Trace entries whose expected chunks lie in several documents."""
    t = inputs.expectations(spark, d).select("id", F.explode("expected_chunk").alias("chunk_id"))
    home = inputs.corpus(spark, d).select(F.col("id").alias("chunk_id"), "document_id")
    n = t.join(home, "chunk_id").groupBy("id").agg(F.count_distinct("document_id").alias("n")).where("n > 1")
    return op.violations(n, "x4", "id", "n")


def q_x_trace_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without trace entry and entries without pair."""
    p = inputs.pairs(spark, d).select(F.concat(F.lit("meta_"), "id").alias("id"))
    t = inputs.expectations(spark, d).select("id")
    return op.violations(p.join(t, "id", "left_anti"), "no entry", "id", F.lit("none")).unionByName(op.violations(t.join(p, "id", "left_anti"), "no pair", "id", F.lit("none")))


def _copied(spark: SparkSession, d: str, field: str, check: str) -> DataFrame:
    p = inputs.pairs(spark, d).select(F.concat(F.lit("meta_"), "id").alias("id"), field)
    return op.copied_field(inputs.expectations(spark, d), "id", field, p, "id", field, check)


def q_x_question_copy(spark: SparkSession, d: str) -> DataFrame:
    return _copied(spark, d, "question", "x6")


def q_x_answer_copy(spark: SparkSession, d: str) -> DataFrame:
    return _copied(spark, d, "expected_answer", "x7")


def q_x_derivations(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose reasoning type or outcome is not what their pair gives."""
    n = F.size(F.filter(F.coalesce("supporting_fact_ids", F.array().cast("array<string>")), lambda k: k.isNotNull()))
    p = inputs.pairs(spark, d).select(F.concat(F.lit("meta_"), "id").alias("id"), F.when(n >= 2, "Multi-hop").otherwise("Single-hop").alias("kind"), F.when(F.col("failure_category") == "No Answer", "Abstain").otherwise("Answer").alias("end"))
    t = inputs.expectations(spark, d).join(p, "id")
    return op.violations(t.where(~F.col("expected_reasoning_type").eqNullSafe(F.col("kind"))), "x8", "id", "kind").unionByName(op.violations(t.where(~F.col("expected_outcome").eqNullSafe(F.col("end"))), "x9", "id", "end"))


def q_x_source_in_manifest(spark: SparkSession, d: str) -> DataFrame:
    return op.orphan_keys(inputs.expectations(spark, d), "id", "expected_source", table(spark, d, "manifest"), "id", "x11")


def q_x_chunk_fk(spark: SparkSession, d: str) -> DataFrame:
    return op.orphan_keys(inputs.expectations(spark, d), "id", "expected_chunk", table(spark, d, "chunks"), "id", "x12")


def q_x_chunk_in_source(spark: SparkSession, d: str) -> DataFrame:
    """Expected chunks that are not of the expected source."""
    t = inputs.expectations(spark, d).select("id", "expected_source", F.explode(F.array_distinct("expected_chunk")).alias("chunk_id"))
    x = t.join(inputs.corpus(spark, d).select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").where("document_id <> expected_source")
    return op.violations(x, "x13", "id", "chunk_id")


def q_x_fact_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Facts that touch no chunk of the corpus."""
    return op.childless(inputs.facts(spark, d), "id", q_fact_chunks(spark, d), "fact_id", "x15")


def q_x_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Entries on a source that is not canonical, though their pair is not about stale or contradicting versions."""
    p = inputs.pairs(spark, d).select(F.concat(F.lit("meta_"), "id").alias("id"), "failure_category")
    m = inputs.manifest(spark, d).select(F.col("id").alias("expected_source"), "canonical")
    t = inputs.expectations(spark, d).join(p, "id").join(m, "expected_source")
    return op.violations(t.where(~F.col("canonical") & ~F.coalesce(F.col("failure_category").isin("Stale Version", "Contradiction"), F.lit(False))), "x17", "id", "expected_source")


# Kinds of failure that a question may probe.
FAILURES = ("Paraphrase", "Exact Fact", "Multi-hop", "No Answer", "False Premise", "Stale Version", "Contradiction")


def q_gd_rules(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose id lacks their source's prefix, whose document is not in the manifest or under another path there,
    or that quote or state what another fact does."""
    f = inputs.facts(spark, d)
    x = f.join(inputs.manifest(spark, d).select(F.col("id").alias("document_id"), F.col("source").alias("path"), F.lit(1).alias("there")), "document_id", "left")
    named = F.col("id").rlike(r"_f[0-9]+\z") & (F.regexp_replace("id", r"_f[0-9]+\z", "") == F.col("source"))
    out = op.violations(x.where(~F.coalesce(named, F.lit(False))), "gd4", "id", "source").unionByName(op.violations(x.where("document_id IS NOT NULL AND there IS NULL"), "gd6", "id", "document_id"))
    out = out.unionByName(op.violations(x.where(F.col("there").isNotNull() & ~F.col("path").eqNullSafe(F.col("document_source"))), "gd7", "id", "document_source"))
    for c, name in (("source_text", "gd12 text"), ("fact", "gd12 fact")):
        again = f.where(F.col(c).isNotNull()).groupBy(F.sha2(c, 256).alias("h")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
        out = out.unionByName(op.violations(again, name, "id", "n"))
    return out


def q_qa_rules(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose id is not that of their fact, whose source is not their fact's, of unknown failure category, asked
    twice, unanswerable but marked answerable, or with malformed or own supporting facts."""
    p = inputs.pairs(spark, d)
    x = p.join(inputs.facts(spark, d).select(F.col("id").alias("fact_id"), F.col("source").alias("theirs"), F.lit(1).alias("there")), "fact_id", "left")
    supports = F.coalesce("supporting_fact_ids", F.array().cast("array<string>"))
    asked = p.where("question IS NOT NULL").groupBy(F.sha2("question", 256).alias("h")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    tests = (
        ("qa4", x.where(~F.coalesce(F.startswith("id", F.concat(F.lit("qa_"), "fact_id", F.lit("_"))), F.lit(False))), "fact_id"),
        ("qa5", x.where(F.col("there").isNotNull() & ~F.col("source").eqNullSafe(F.col("theirs"))), "source"),
        ("qa7", x.where(~F.coalesce(F.col("failure_category").isin(*FAILURES), F.lit(False))), "failure_category"),
        ("qa8 repeated", asked, "n"),
        ("qa8 answerable", x.where(F.col("failure_category").eqNullSafe("No Answer") & F.coalesce("answerable", F.lit(True))), "failure_category"),
        ("qa9 form", x.where(F.exists(supports, lambda k: k.isNull() | ~k.rlike(r"^[a-z]+_f[0-9]+\z"))), "fact_id"),
        ("qa9 own", x.where(F.exists(supports, lambda k: k.eqNullSafe(F.col("fact_id")) & k.isNotNull())), "fact_id"),
    )
    found = [op.violations(rows, name, "id", detail) for name, rows, detail in tests]
    return reduce(DataFrame.unionByName, found)


def q_et_rules(spark: SparkSession, d: str) -> DataFrame:
    """Trace entries with malformed or repeated expected chunks, with metrics missing or blank, or with a route."""
    t = inputs.expectations(spark, d)
    none = F.array().cast("array<string>")
    chunks, metrics = F.coalesce("expected_chunk", none), F.coalesce("expected_metrics", none)
    tests = (
        ("et5 chunk", t.where(F.exists(chunks, lambda k: k.isNull() | ~k.rlike(r"^[0-9a-f]{16}\z"))), F.size(chunks)),
        ("et5 repeated", t.where(F.size(F.array_distinct(chunks)) < F.size(chunks)), F.size(chunks)),
        ("et5 metrics", t.where((F.size(metrics) == 0) | F.exists(metrics, lambda k: k.isNull() | (F.trim(k) == ""))), F.size(metrics)),
        ("et5 route", t.where("expected_retrieval_route IS NOT NULL"), F.col("expected_retrieval_route")),
    )
    return reduce(DataFrame.unionByName, [op.violations(rows, name, "id", detail) for name, rows, detail in tests])


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """(id, fact_id, expected_source): the facts that each trace entry's pair cites."""
    keys = F.array_distinct(F.filter(F.concat(F.array("fact_id"), F.coalesce("supporting_fact_ids", F.array().cast("array<string>"))), lambda k: k.isNotNull()))
    p = inputs.pairs(spark, d).select(F.concat(F.lit("meta_"), "id").alias("id"), F.col("fact_id").alias("parent"), F.explode(keys).alias("fact_id"))
    return p.join(inputs.expectations(spark, d).select("id", "expected_source"), "id")


def q_x_source_of_fact(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose source is not the document of their pair's fact."""
    f = inputs.facts(spark, d).select(F.col("id").alias("fact_id"), "document_id")
    x = _cited(spark, d).where("fact_id = parent").join(f, "fact_id").where(~F.col("document_id").eqNullSafe(F.col("expected_source")))
    return op.violations(x, "x10", "id", "expected_source")


def q_x_chunk_order(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose expected chunks do not rise by their place in the document; unknown chunks are passed over."""
    t = inputs.expectations(spark, d).select("id", F.posexplode("expected_chunk").alias("place", "chunk_id"))
    x = t.join(inputs.corpus(spark, d).select(F.col("id").alias("chunk_id"), "chunk_index"), "chunk_id")
    before = F.lag("chunk_index").over(Window.partitionBy("id").orderBy("place"))
    falls = x.withColumn("before", before).where("chunk_index < before").groupBy("id").agg(F.count("*").alias("n"))
    return op.violations(falls, "x14", "id", "n")


def q_x_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Cited facts whose source text does not stand in the entry's expected source."""
    f = inputs.facts(spark, d).where("source_text <> ''").select(F.col("id").alias("fact_id"), "source_text")
    x = _cited(spark, d).join(f, "fact_id").join(inputs.documents(spark, d).select(F.col("document_id").alias("expected_source"), "text"), "expected_source")
    return op.violations(x.where(~F.contains("text", F.col("source_text"))), "x16", "id", "fact_id")


_SUITE = (q_dq_hash_freshness, q_dq_unchunked, q_dq_chunk_orphans, q_dq_manifest_fields, q_gd_fields, q_gd_verbatim, q_qa_fields, q_et_fields, q_x_fact_fk, q_x_supporting_fk, q_x_empty_evidence, q_x_question_copy, q_x_answer_copy, q_x_source_in_manifest, q_x_chunk_fk, q_x_fact_coverage, q_x_canonical, q_dq_unique_ids, q_dq_completeness, q_dq_chunk_contract, q_gd_rules, q_qa_rules, q_et_rules, q_x_single_document, q_x_trace_pairs, q_x_derivations, q_x_source_of_fact, q_x_chunk_in_source, q_x_chunk_order, q_x_grounded)
_CHECKS = ("dq1", "dq4", "dq6", "manifest", "gd", "gd_verbatim", "qa", "et", "x1", "x2", "x3", "x6", "x7", "x11", "x12", "x15", "x17")
# Checks that one query makes several of.
_MORE = {
    "q_dq_unique_ids": ("manifest", "chunks", "resume_facts", "resume_qa_pairs", "resume_evidence_trace", "generation_results"), "q_dq_completeness": ("no entry", "no document"), "q_dq_chunk_contract": ("fields", "length"),
    "q_gd_rules": ("gd4", "gd6", "gd7", "gd12 text", "gd12 fact"), "q_qa_rules": ("qa4", "qa5", "qa7", "qa8 repeated", "qa8 answerable", "qa9 form", "qa9 own"), "q_et_rules": ("et5 chunk", "et5 repeated", "et5 metrics", "et5 route"),
    "q_x_single_document": ("x4",), "q_x_trace_pairs": ("no entry", "no pair"), "q_x_derivations": ("x8", "x9"), "q_x_source_of_fact": ("x10",), "q_x_chunk_in_source": ("x13",), "q_x_chunk_order": ("x14",), "q_x_grounded": ("x16",),
}


def q_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """One row per check of every query here, PASS or FAIL, with its violations."""
    named = [(f.__name__, f(spark, d)) for f in _SUITE]
    # Those that make several checks are named with their query, as two of them use one name.
    found = [x if n not in _MORE else x.withColumn("check", F.concat(F.lit(n.removeprefix("q_") + ": "), "check")) for n, x in named]
    return op.report(found, [*_CHECKS, *(f"{n.removeprefix('q_')}: {c}" for n, checks in _MORE.items() for c in checks)])


QUERIES = {
    f.__name__: f
    for f in (
        q_dq_hash_freshness, q_dq_unique_ids, q_dq_completeness, q_dq_unchunked, q_dq_chunk_contract, q_dq_chunk_orphans, q_dq_manifest_fields, q_gd_fields, q_gd_verbatim, q_qa_fields, q_et_fields, q_x_fact_fk, q_x_supporting_fk,
        q_x_empty_evidence, q_x_single_document, q_x_trace_pairs, q_x_question_copy, q_x_answer_copy, q_x_derivations, q_x_source_in_manifest, q_x_chunk_fk, q_x_chunk_in_source, q_x_fact_coverage, q_x_canonical, q_gd_rules, q_qa_rules, q_et_rules, q_x_source_of_fact, q_x_chunk_order, q_x_grounded, q_quality_report,
    )
}

_v = lambda check, key, detail, rest: f"SELECT '{check}' AS \"check\", CAST({key} AS VARCHAR) AS key, CAST({detail} AS VARCHAR) AS detail FROM {rest}"


def _fields(table_: str, check: str, fields: dict[str, str], where: str = "true") -> str:
    bad = ", ".join(f"CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR), ' ') = ''" + (f" OR NOT regexp_matches(CAST({c} AS VARCHAR), '{p}')" if p else "") + f" THEN '{c}' END" for c, p in fields.items())
    return f"SELECT '{check}' AS \"check\", id AS key, array_to_string(list_filter(bad, lambda b: b IS NOT NULL), ',') AS detail FROM (SELECT id, [{bad}] AS bad FROM (SELECT DISTINCT {', '.join(fields)} FROM {table_} WHERE {where})) WHERE len(list_filter(bad, lambda b: b IS NOT NULL)) > 0"


_M, _C, _F, _P, _T = ("WITH " + x for x in (inputs.MANIFEST, inputs.CORPUS, inputs.FACTS, inputs.PAIRS, inputs.TRACE))
_PT = "WITH " + inputs.PAIRS + ", " + inputs.TRACE + " "
_FC = "WITH " + inputs.CORPUS + ", " + inputs.FACTS + ", spans AS (SELECT f.id AS fact_id, f.document_id, strpos(d.text, f.source_text) - 1 AS a, length(f.source_text) AS n FROM fact f JOIN documents d ON d.document_id = f.document_id WHERE f.source_text <> '' AND d.text IS NOT NULL), fc AS (SELECT DISTINCT fact_id FROM spans s JOIN corpus c ON c.document_id = s.document_id AND c.character_end > a AND c.character_start < a + n WHERE a >= 0) "

ORACLE = {
    "q_dq_hash_freshness": _M + " " + _v("dq1", "m.id", "'stale'", "man m JOIN documents d ON d.document_id = m.id WHERE d.text IS NOT NULL AND sha256(d.text) <> m.hash"),
    "q_dq_unique_ids": " UNION ALL ".join(_v(n, "id", "count(*)", f"{n} GROUP BY id HAVING count(*) > 1") for n in ("manifest", "chunks", "resume_facts", "resume_qa_pairs", "resume_evidence_trace", "generation_results")),
    "q_dq_completeness": _M + " " + _v("no entry", "document_id", "'none'", "documents WHERE document_id NOT IN (SELECT id FROM man)") + " UNION ALL " + _v("no document", "id", "'none'", "man WHERE id NOT IN (SELECT document_id FROM documents WHERE document_id IS NOT NULL)"),
    "q_dq_unchunked": _C + " " + _v("dq4", "document_id", "'none'", "documents d WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM corpus c WHERE c.document_id = d.document_id)"),
    "q_dq_chunk_contract": _fields("chunks", "fields", {"id": "^[0-9a-f]{16}$", "document_id": "^[0-9a-f]{12}$", "text": "", "chunk_index": "^[0-9]+$", "character_start": "^[0-9]+$", "character_end": "^[0-9]+$"}, "deleted_at IS NULL")
    + " UNION ALL " + _v("length", "id", "length(text) - character_end + character_start", "(SELECT DISTINCT id, document_id, text, chunk_index, character_start, character_end FROM chunks WHERE deleted_at IS NULL) WHERE length(text) <> character_end - character_start"),
    "q_dq_chunk_orphans": _C + " " + _v("dq6", "id", "document_id", "corpus WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM documents WHERE document_id IS NOT NULL)"),
    "q_dq_manifest_fields": _fields("manifest", "manifest", {"id": "^[0-9a-f]{12}$", "source": "", "hash": "^[0-9a-f]{64}$", "canonical": "", "manifest_version": r"^1\.0$"}),
    "q_gd_fields": _fields("resume_facts", "gd", {"id": "^[a-z]+_f[0-9]+$", "source": "", "document_id": "^[0-9a-f]{12}$", "document_source": "", "section": "", "fact": "", "source_text": ""}),
    "q_gd_verbatim": _F + " " + _v("gd_verbatim", "f.id", "(length(d.text) - length(replace(d.text, f.source_text, ''))) // length(f.source_text)", "fact f JOIN documents d ON d.document_id = f.document_id WHERE d.text IS NOT NULL AND f.source_text <> '' AND (length(d.text) - length(replace(d.text, f.source_text, ''))) // length(f.source_text) <> 1"),
    "q_qa_fields": _fields("resume_qa_pairs", "qa", {"id": "^qa_[a-z]+_f[0-9]+_[a-z]+_[0-9]+$", "source": "", "fact_id": "^[a-z]+_f[0-9]+$", "fact_relation": "^(supports|bounds|refutes)$", "question": "", "question_category": "^(reasoning|lexical|semantic|summarization)$", "expected_answer": "", "answerable": ""}),
    "q_et_fields": _fields("resume_evidence_trace", "et", {"id": "^meta_qa_", "question": "", "expected_answer": "", "expected_source": "^[0-9a-f]{12}$", "expected_reasoning_type": "^(Single-hop|Multi-hop)$", "expected_outcome": "^(Answer|Abstain)$"}),
    "q_x_fact_fk": _P + " " + _v("x1", "id", "fact_id", "pair p WHERE fact_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM resume_facts f WHERE f.id = p.fact_id)"),
    "q_x_supporting_fk": _P + " " + _v("x2", "id", "k", "(SELECT id, unnest(supporting_fact_ids) AS k FROM pair) p WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM resume_facts f WHERE f.id = p.k)"),
    "q_x_empty_evidence": _T + " " + _v("x3", "id", "'empty'", "trace WHERE expected_chunk IS NULL OR len(expected_chunk) = 0"),
    "q_x_single_document": "WITH " + inputs.CORPUS + ", " + inputs.TRACE + " " + _v("x4", "t.id", "count(DISTINCT c.document_id)", "(SELECT id, unnest(expected_chunk) AS k FROM trace) t JOIN corpus c ON c.id = t.k GROUP BY t.id HAVING count(DISTINCT c.document_id) > 1"),
    "q_x_trace_pairs": _PT + _v("no entry", "'meta_' || p.id", "'none'", "pair p WHERE 'meta_' || p.id NOT IN (SELECT id FROM trace)") + " UNION ALL " + _v("no pair", "t.id", "'none'", "trace t WHERE t.id NOT IN (SELECT 'meta_' || id FROM pair)"),
    "q_x_question_copy": _PT + _v("x6", "t.id", "'differs'", "trace t JOIN pair p ON t.id = 'meta_' || p.id WHERE t.question IS DISTINCT FROM p.question"),
    "q_x_answer_copy": _PT + _v("x7", "t.id", "'differs'", "trace t JOIN pair p ON t.id = 'meta_' || p.id WHERE t.expected_answer IS DISTINCT FROM p.expected_answer"),
    "q_x_derivations": _PT + ", dv AS (SELECT t.id, t.expected_reasoning_type, t.expected_outcome, CASE WHEN len(list_filter(coalesce(p.supporting_fact_ids, []), lambda x: x IS NOT NULL)) >= 2 THEN 'Multi-hop' ELSE 'Single-hop' END AS kind, CASE WHEN p.failure_category = 'No Answer' THEN 'Abstain' ELSE 'Answer' END AS fin FROM trace t JOIN pair p ON t.id = 'meta_' || p.id) "
    + _v("x8", "id", "kind", "dv WHERE expected_reasoning_type IS DISTINCT FROM kind") + " UNION ALL " + _v("x9", "id", "fin", "dv WHERE expected_outcome IS DISTINCT FROM fin"),
    "q_x_source_in_manifest": _T + " " + _v("x11", "id", "expected_source", "trace t WHERE expected_source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.id = t.expected_source)"),
    "q_x_chunk_fk": _T + " " + _v("x12", "id", "k", "(SELECT id, unnest(expected_chunk) AS k FROM trace) t WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.id = t.k)"),
    "q_x_chunk_in_source": "WITH " + inputs.CORPUS + ", " + inputs.TRACE + " " + _v("x13", "t.id", "t.k", "(SELECT id, expected_source, unnest(list_distinct(expected_chunk)) AS k FROM trace) t JOIN corpus c ON c.id = t.k WHERE c.document_id <> t.expected_source"),
    "q_x_fact_coverage": _FC + _v("x15", "id", "'none'", "fact WHERE id NOT IN (SELECT fact_id FROM fc)"),
    "q_x_canonical": "WITH " + inputs.MANIFEST + ", " + inputs.PAIRS + ", " + inputs.TRACE + " " + _v("x17", "t.id", "t.expected_source", "trace t JOIN pair p ON t.id = 'meta_' || p.id JOIN man m ON m.id = t.expected_source WHERE NOT m.canonical AND coalesce(p.failure_category, '') NOT IN ('Stale Version', 'Contradiction')"),
}
_CITED = "cited AS (SELECT x.id, x.parent, x.fact_id, t.expected_source FROM (SELECT 'meta_' || id AS id, fact_id AS parent, unnest(list_distinct(list_filter([fact_id] || coalesce(supporting_fact_ids, []), lambda k: k IS NOT NULL))) AS fact_id FROM pair) x JOIN trace t ON t.id = x.id) "
_FM = "WITH " + inputs.FACTS + ", " + inputs.MANIFEST + " "
_FP = "WITH " + inputs.FACTS + ", " + inputs.PAIRS + " "
_FPT = "WITH " + inputs.FACTS + ", " + inputs.PAIRS + ", " + inputs.TRACE + ", " + _CITED
_again = lambda name, c, rest: _v(name, "min(id)", "count(*)", f"{rest} WHERE {c} IS NOT NULL GROUP BY sha256({c}) HAVING count(*) > 1")
_known = ", ".join(f"'{c}'" for c in FAILURES)
_PF = "pair p LEFT JOIN fact f ON f.id = p.fact_id"
ORACLE |= {
    "q_gd_rules": _FM + " UNION ALL ".join((
        _v("gd4", "id", "source", "fact WHERE NOT coalesce(regexp_matches(id, '_f[0-9]+$') AND regexp_replace(id, '_f[0-9]+$', '') = source, false)"),
        _v("gd6", "f.id", "f.document_id", "fact f LEFT JOIN man m ON m.id = f.document_id WHERE f.document_id IS NOT NULL AND m.id IS NULL"),
        _v("gd7", "f.id", "f.document_source", "fact f JOIN man m ON m.id = f.document_id WHERE m.source IS DISTINCT FROM f.document_source"),
        _again("gd12 text", "source_text", "fact"), _again("gd12 fact", "fact", "fact"),
    )),
    "q_qa_rules": _FP + " UNION ALL ".join((
        _v("qa4", "id", "fact_id", "pair WHERE NOT coalesce(starts_with(id, 'qa_' || fact_id || '_'), false)"),
        _v("qa5", "p.id", "p.source", "pair p JOIN fact f ON f.id = p.fact_id WHERE p.source IS DISTINCT FROM f.source"),
        _v("qa7", "id", "failure_category", f"pair WHERE NOT coalesce(failure_category IN ({_known}), false)"), _again("qa8 repeated", "question", "pair"),
        _v("qa8 answerable", "id", "failure_category", "pair WHERE failure_category = 'No Answer' AND coalesce(answerable, true)"),
        _v("qa9 form", "id", "fact_id", "pair WHERE len(list_filter(coalesce(supporting_fact_ids, []), lambda k: k IS NULL OR NOT regexp_matches(k, '^[a-z]+_f[0-9]+$'))) > 0"),
        _v("qa9 own", "id", "fact_id", "pair WHERE list_contains(supporting_fact_ids, fact_id)"),
    )),
    "q_et_rules": _T + " " + " UNION ALL ".join((
        _v("et5 chunk", "id", "len(expected_chunk)", "trace WHERE len(list_filter(coalesce(expected_chunk, []), lambda k: k IS NULL OR NOT regexp_matches(k, '^[0-9a-f]{16}$'))) > 0"),
        _v("et5 repeated", "id", "len(expected_chunk)", "trace WHERE len(list_distinct(expected_chunk)) + CASE WHEN len(list_filter(expected_chunk, lambda k: k IS NULL)) > 0 THEN 1 ELSE 0 END < len(expected_chunk)"),
        _v("et5 metrics", "id", "len(coalesce(expected_metrics, []))", "trace WHERE len(coalesce(expected_metrics, [])) = 0 OR len(list_filter(expected_metrics, lambda k: k IS NULL OR trim(k, ' ') = '')) > 0"),
        _v("et5 route", "id", "expected_retrieval_route", "trace WHERE expected_retrieval_route IS NOT NULL"),
    )),
    "q_x_source_of_fact": _FPT + _v("x10", "c.id", "c.expected_source", "cited c JOIN fact f ON f.id = c.fact_id WHERE c.fact_id = c.parent AND f.document_id IS DISTINCT FROM c.expected_source"),
    "q_x_chunk_order": "WITH " + inputs.CORPUS + ", " + inputs.TRACE + ", placed AS (SELECT t.id, t.place, c.chunk_index, lag(c.chunk_index) OVER (PARTITION BY t.id ORDER BY t.place) AS before FROM (SELECT id, unnest(expected_chunk) AS k, generate_subscripts(expected_chunk, 1) AS place FROM trace) t JOIN corpus c ON c.id = t.k) " + _v("x14", "id", "count(*)", "placed WHERE chunk_index < before GROUP BY id"),
    "q_x_grounded": _FPT + _v("x16", "c.id", "c.fact_id", "cited c JOIN fact f ON f.id = c.fact_id JOIN documents d ON d.document_id = c.expected_source WHERE d.text IS NOT NULL AND f.source_text <> '' AND NOT contains(d.text, f.source_text)"),
}
_REPORTED = {"dq1": "q_dq_hash_freshness", "dq4": "q_dq_unchunked", "dq6": "q_dq_chunk_orphans", "manifest": "q_dq_manifest_fields", "gd": "q_gd_fields", "gd_verbatim": "q_gd_verbatim", "qa": "q_qa_fields", "et": "q_et_fields", "x1": "q_x_fact_fk", "x2": "q_x_supporting_fk", "x3": "q_x_empty_evidence", "x6": "q_x_question_copy", "x7": "q_x_answer_copy", "x11": "q_x_source_in_manifest", "x12": "q_x_chunk_fk", "x15": "q_x_fact_coverage", "x17": "q_x_canonical"}
ORACLE["q_quality_report"] = " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS violations FROM ({ORACLE[q]}) WHERE \"check\" = '{c}'"
    for name, c, q in [(c, c, q) for c, q in _REPORTED.items()] + [(f"{q.removeprefix('q_')}: {c}", c, q) for q, checks in _MORE.items() for c in checks]
)
