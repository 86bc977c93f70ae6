"""Set-based evaluation of retrieval, its metrics, and a second derivation of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import share

# How an observed set relates to an expected one.
EXACT, FULL, PARTIAL, NONE = "Exact Match", "Full Coverage", "Partial Match", "No Match"
LABELS = (EXACT, FULL, PARTIAL, NONE)
_EMPTY = "array<string>"


def classify(expected: Column, observed: Column) -> Column:
    """Equal, contained in the observed set, overlapping, or disjoint; null for an empty expectation."""
    e, o = F.array_distinct(expected), F.array_distinct(observed)
    common = F.size(F.array_intersect(e, o))
    return (
        F.when(F.size(e) == 0, F.lit(None).cast("string"))
        .when((common == F.size(e)) & (F.size(o) == F.size(e)), EXACT)
        .when(common == F.size(e), FULL)
        .when(common > 0, PARTIAL)
        .otherwise(NONE)
    )


def _ids(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast(_EMPTY)), lambda x: x.isNotNull())))


def evaluation_records(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One record per expectation that has chunks: label, sorted sets and counts.

    ``expected`` has id and expected_chunk, ``observed`` id and observed_chunk; an expectation nobody
    observed has an empty observed set. Observations without expectation are left to ``unmatched_ids``. The sets
    are sorted and merged: they take several times the room of the ids that the planner judges them by.
    """
    x = expected.select("id", _ids("expected_chunk").alias("e")).where(F.size("e") > 0)
    x = x.join(observed.select("id", _ids("observed_chunk").alias("o")).hint("merge"), "id", "left").withColumn("o", F.coalesce("o", F.array().cast(_EMPTY)))
    matched = F.array_sort(F.array_intersect("e", "o"))
    return x.select(
        "id", classify(F.col("e"), F.col("o")).alias("classification"), F.col("e").alias("expected_chunk_ids"), F.col("o").alias("observed_chunk_ids"), matched.alias("matched_chunk_ids"),
        F.array_sort(F.array_except("e", "o")).alias("missing_chunk_ids"), F.array_sort(F.array_except("o", "e")).alias("unexpected_chunk_ids"),
        F.size("e").alias("expected_count"), F.size("o").alias("observed_count"), F.size(matched).alias("matched_count"),
    )


def unmatched_ids(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(id, problem): ids on one side only, and ids that stand there more than once."""
    e, o = expected.groupBy("id").agg(F.count("*").alias("ne")), observed.groupBy("id").agg(F.count("*").alias("no"))
    x = e.join(o, "id", "full_outer")
    problem = F.when(F.col("no").isNull(), "not observed").when(F.col("ne").isNull(), "not expected").when((F.col("ne") > 1) | (F.col("no") > 1), "repeated")
    return x.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def with_documents(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records with the sorted documents of their expected and observed chunks; unknown chunks have none."""
    home = chunks.select(F.col("id").alias("chunk_id"), "document_id").distinct()

    def documents(c: str, name: str) -> DataFrame:
        return records.select("id", F.explode(c).alias("chunk_id")).join(home, "chunk_id").groupBy("id").agg(F.array_sort(F.collect_set("document_id")).alias(name))

    none = F.array().cast(_EMPTY)
    x = records.join(documents("expected_chunk_ids", "expected_document_ids"), "id", "left").join(documents("observed_chunk_ids", "observed_document_ids"), "id", "left")
    return x.withColumns({c: F.coalesce(c, none) for c in ("expected_document_ids", "observed_document_ids")})


def classification_counts(records: DataFrame) -> DataFrame:
    """One row: questions, each label's count and rate, hits and hit rate; labels count at zero too."""
    n = {k: F.count_if(F.col("classification") == v) for k, v in zip(("exact", "full", "partial", "no_match"), LABELS)}
    hits = n["exact"] + n["full"] + n["partial"]
    return records.agg(F.count("*").alias("questions"), *(v.alias(k) for k, v in n.items()), *(share(v, F.count("*")).alias(f"{k}_rate") for k, v in n.items()), hits.alias("hits"), share(hits, F.count("*")).alias("hit_rate"))


def question_metrics(records: DataFrame) -> DataFrame:
    """(id, matched, observed, expected, precision, recall) per question, rounded to 4 digits."""
    return records.select("id", "matched_count", "observed_count", "expected_count", share(F.col("matched_count"), F.col("observed_count")).alias("precision"), share(F.col("matched_count"), F.col("expected_count")).alias("recall"))


def retrieval_metrics(records: DataFrame) -> DataFrame:
    """One row: precision and recall, micro (of sums) and macro (mean of unrounded ratios)."""
    p, r = share(F.col("matched_count"), F.col("observed_count"), None), share(F.col("matched_count"), F.col("expected_count"), None)
    s = {c: F.coalesce(F.sum(f"{c}_count"), F.lit(0)) for c in ("matched", "observed", "expected")}
    return records.agg(
        *(v.alias(f"{k}_total") for k, v in s.items()), share(s["matched"], s["observed"]).alias("precision_micro"), F.round(F.coalesce(F.avg(p), F.lit(0.0)), 4).alias("precision_macro"),
        share(s["matched"], s["expected"]).alias("recall_micro"), F.round(F.coalesce(F.avg(r), F.lit(0.0)), 4).alias("recall_macro"),
    )


def evaluation_summary(records: DataFrame) -> DataFrame:
    """One row: references and distinct chunks of either side, their overlap, and how often each is used."""
    side = lambda c, s: records.select(F.explode(c).alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias(s))
    x = side("expected_chunk_ids", "e").join(side("observed_chunk_ids", "o"), "chunk_id", "full_outer")
    ne, no = F.count("e"), F.count("o")
    return x.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_references"), ne.alias("expected_unique"), F.coalesce(F.sum("o"), F.lit(0)).alias("observed_references"), no.alias("observed_unique"),
        F.count_if(F.col("e").isNotNull() & F.col("o").isNotNull()).alias("common_unique"), F.count_if(F.col("o").isNull()).alias("expected_only"), F.count_if(F.col("e").isNull()).alias("observed_only"),
        share(F.coalesce(F.sum("o"), F.lit(0)), no).alias("observed_reuse"),
    )


def document_distribution(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(side, document_id, n): references to each document from expected and observed chunks."""
    home = chunks.select(F.col("id").alias("chunk_id"), "document_id").distinct()
    side = lambda c, s: records.select(F.lit(s).alias("side"), F.explode(c).alias("chunk_id"))
    refs = side("expected_chunk_ids", "expected").unionByName(side("observed_chunk_ids", "observed"))
    return refs.join(home, "chunk_id").groupBy("side", "document_id").agg(F.count("*").alias("n"))


def independent_check(records: DataFrame) -> DataFrame:
    """(check, status): metrics derived again from the sets, compared exactly with those from labels and counts."""
    e, o = F.col("expected_chunk_ids"), F.col("observed_chunk_ids")
    inside = F.size(F.filter(e, lambda x: F.array_contains(o, x)))
    n = F.count("*")
    hit, labelled = F.count_if(inside > 0), F.count_if(F.col("classification") != NONE)
    totals = records.agg(
        (hit == labelled).alias("hits from labels and from sets"), (F.count_if(inside != F.col("matched_count")) == 0).alias("matched counts"), (F.count_if((F.size(e) != F.col("expected_count")) | (F.size(o) != F.col("observed_count"))) == 0).alias("set sizes"),
        (sum((F.count_if(F.col("classification") == v) for v in LABELS[1:]), F.count_if(F.col("classification") == LABELS[0])) == n).alias("labels cover all"), (hit + F.count_if(F.col("classification") == NONE) == n).alias("hit is not none"),
        (F.count_if(classify(e, o) != F.col("classification")) == 0).alias("labels"), (F.count_distinct("id") == n).alias("unique ids"),
    )
    return totals.unpivot([], totals.columns, "check", "passed").select("check", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"))


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, absolute, relative) of metrics both have, each rounded to 4 digits; relative is
    null where before is 0."""
    x = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric")
    d = F.col("after") - F.col("before")
    return x.select("metric", "before", "after", F.round(d, 4).alias("absolute"), F.round(F.try_divide(d, F.when(F.col("before") != 0, F.col("before"))), 4).alias("relative"))


def as_metrics(row: DataFrame) -> DataFrame:
    """(metric, value): a one-row frame of numbers in long form."""
    numbers = row.select(*(F.col(c).cast("double").alias(c) for c in row.columns))
    return numbers.unpivot([], numbers.columns, "metric", "value")


def run_summary(observed: DataFrame, corpus_size: DataFrame) -> DataFrame:
    """One row on a run: questions, retrieved, distinct, mean and extreme sizes, empty results, use of the corpus."""
    n = F.size(F.coalesce("observed_chunk", F.array().cast(_EMPTY)))
    per = observed.agg(F.count("*").alias("questions"), F.sum(n).alias("retrieved"), F.round(F.avg(n), 4).alias("mean_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.count_if(n == 0).alias("empty"))
    distinct = observed.select(F.explode("observed_chunk").alias("c")).agg(F.count_distinct("c").alias("distinct_chunks"))
    return per.join(distinct).join(corpus_size).select("*", share(F.col("retrieved"), F.col("distinct_chunks")).alias("reuse"), share(F.col("distinct_chunks"), F.col("n")).alias("utilisation"))
