"""Metrics on judged propositions. The judge is a seam: a function from columns to a verdict column.

Each proposition passes the judge only what it may see: relevance a question and a passage; recall a claim
and the context; support a claim and the context; grounding a claim and one passage; relevancy a question
and an answer. ``containment_judge`` is a deterministic stand-in made of built-in expressions; a model goes
in its place as a pandas UDF of the same arguments (mark it non-deterministic, so it runs once a row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import claims, share, tokens

# The closed vocabularies of verdicts.
RELEVANT, NOT_RELEVANT = "RELEVANT", "NOT_RELEVANT"
SUPPORTED, PARTIALLY, CONTRADICTED, NOT_SUPPORTED = "SUPPORTED", "PARTIALLY_SUPPORTED", "CONTRADICTED", "NOT_SUPPORTED"
HALLUCINATED = (NOT_SUPPORTED, CONTRADICTED)
RELEVANCY = (("direct", "DIRECT", "NOT_DIRECT"), ("complete", "COMPLETE", "NOT_COMPLETE"), ("only", "ONLY", "NOT_ONLY"))

Judge = Callable[[Column, Column], Column]


def coverage(claim: Column, passage: Column) -> Column:
    """The share of a claim's distinct tokens that stand in a passage; 0 for a claim without tokens."""
    c = F.array_distinct(tokens(claim))
    return share(F.size(F.array_intersect(c, tokens(passage))), F.size(c), None)


def containment_judge(yes: str, no: str, least: float, partly: str | None = None, some: float = 0.5) -> Judge:
    """A judge that goes by token coverage of its first argument by its second."""

    def judge(claim: Column, passage: Column) -> Column:
        c = coverage(claim, passage)
        said = F.when(c >= least, yes)
        return (said.when(c >= some, partly) if partly else said).otherwise(no)

    return judge


relevance_judge = containment_judge(RELEVANT, NOT_RELEVANT, 0.3)
support_judge = containment_judge(SUPPORTED, NOT_SUPPORTED, 0.8, PARTIALLY)
attribution_judge = containment_judge(SUPPORTED, NOT_SUPPORTED, 0.8)


def context_precision(cases: DataFrame, judge: Judge = relevance_judge) -> DataFrame:
    """(id, retrieved, relevant, precision): per case with question and passages (array of id, text); 0.0 and no
    judgement without passages."""
    each = cases.select("id", "question", F.explode("passages").alias("p")).select("id", (judge(F.col("question"), F.col("p.text")) == RELEVANT).cast("int").alias("yes"))
    per = each.groupBy("id").agg(F.sum("yes").alias("relevant"))
    return cases.select("id", F.size("passages").alias("retrieved")).join(per, "id", "left").select("id", "retrieved", F.coalesce("relevant", F.lit(0)).alias("relevant"), share(F.coalesce("relevant", F.lit(0)), F.col("retrieved")).alias("precision"))


def context_recall(cases: DataFrame, judge: Judge = attribution_judge) -> DataFrame:
    """(id, claims, supported, recall): reference claims (of ``reference``) that the joined context supports."""
    context = F.array_join(F.transform("passages", lambda p: p["text"]), "\n\n")
    each = cases.where(F.size("passages") > 0).select("id", context.alias("context"), F.explode(claims(F.col("reference"))).alias("claim"))
    per = each.select("id", (judge(F.col("claim"), F.col("context")) == SUPPORTED).cast("int").alias("yes")).groupBy("id").agg(F.count("*").alias("claims"), F.sum("yes").alias("supported"))
    zero = F.lit(0).cast("long")
    return cases.select("id").join(per, "id", "left").select("id", F.coalesce("claims", zero).alias("claims"), F.coalesce("supported", zero).alias("supported"), share(F.coalesce("supported", zero), F.coalesce("claims", zero)).alias("recall"))


def precision_aggregate(per: DataFrame) -> DataFrame:
    """One row: macro over unrounded ratios, micro over sums, and cases without passages."""
    ratio = share(F.col("relevant"), F.col("retrieved"), None)
    return per.agg(F.count("*").alias("cases"), F.count_if(F.col("retrieved") == 0).alias("without_context"), F.round(F.coalesce(F.avg(ratio), F.lit(0.0)), 4).alias("macro"), share(F.sum("relevant"), F.sum("retrieved")).alias("micro"))


def recall_aggregate(per: DataFrame) -> DataFrame:
    """One row: macro over the ratios as rounded per case, micro over sums."""
    return per.agg(F.count("*").alias("cases"), F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 4).alias("macro"), share(F.sum("supported"), F.sum("claims")).alias("micro"))


def claim_verdicts(cases: DataFrame, support: Judge = support_judge, attribution: Judge = attribution_judge) -> DataFrame:
    """(id, n, claim, support, faithful, hallucinated, first_passage, judged_passages, grounded, inconsistent).

    Per claim of an answering case: its verdict on the whole context, and the first passage that supports it
    alone. Passages after that one are not counted as judged. Abstaining cases have no claims.
    """
    context = F.array_join(F.transform("passages", lambda p: p["text"]), "\n\n")
    x = cases.where("outcome <> 'Abstain'").select("id", "passages", context.alias("context"), F.posexplode(claims(F.col("answer_text"))).alias("n", "claim"))
    x = x.withColumn("support", support(F.col("claim"), F.col("context")))
    alone = F.transform("passages", lambda p: attribution(F.col("claim"), p["text"]))
    x = x.withColumn("first", F.array_position(alone, SUPPORTED).cast("int"))
    grounded, faithful = F.col("first") > 0, F.col("support") == SUPPORTED
    return x.select(
        "id", "n", "claim", "support", faithful.alias("faithful"), F.col("support").isin(*HALLUCINATED).alias("hallucinated"), F.when(grounded, F.element_at(F.transform("passages", lambda p: p["id"]), F.when(grounded, F.col("first")).otherwise(1))).alias("first_passage"),
        F.when(grounded, F.col("first")).otherwise(F.size("passages")).alias("judged_passages"), grounded.alias("grounded"), (grounded & ~faithful).alias("inconsistent"),
    )


def claim_metrics(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, claims, faithfulness, groundedness, hallucination_rate): null where a case carries no claims."""
    n = F.count("*")
    rate = lambda c: F.round(F.count_if(c) / n, 4)
    per = verdicts.groupBy("id").agg(n.alias("claims"), F.count_if("faithful").alias("faithful"), F.count_if("grounded").alias("grounded"), F.count_if("hallucinated").alias("hallucinated"), F.count_if("inconsistent").alias("inconsistent"), rate("faithful").alias("faithfulness"), rate("grounded").alias("groundedness"), rate("hallucinated").alias("hallucination_rate"))
    return cases.select("id").join(per, "id", "left")


def claim_aggregate(per: DataFrame, metric: str, count: str) -> DataFrame:
    """One row: measured and unmeasured cases, macro over measured cases, micro over their claims; null if none."""
    return per.agg(
        F.count("claims").alias("measured"), F.count_if(F.col("claims").isNull()).alias("unmeasured"), F.sum("claims").alias("claims"), F.sum(count).alias("hits"),
        F.round(F.avg(F.col(count) / F.col("claims")), 4).alias("macro"), F.round(F.try_divide(F.sum(count).cast("double"), F.sum("claims")), 4).alias("micro"),
    ).select(F.lit(metric).alias("metric"), "*")


def relevancy_judge(q: Column, a: Column) -> Column:
    """The stand-in: direct if a third of the question's tokens recur, complete if the answer has five tokens or a
    figure, only if it is not over twelve times the question's length. A model's three lines go through
    ``parsed_relevancy`` to the same struct."""
    direct = F.when(coverage(q, a) >= 0.3, "DIRECT").otherwise("NOT_DIRECT")
    complete = F.when((F.size(tokens(a)) >= 5) | a.rlike("[0-9]"), "COMPLETE").otherwise("NOT_COMPLETE")
    only = F.when(F.length(a) <= 12 * F.length(q), "ONLY").otherwise("NOT_ONLY")
    return F.struct(*(v.alias(n) for (n, _, _), v in zip(RELEVANCY, (direct, complete, only))))


def relevancy(cases: DataFrame, judge: Judge = relevancy_judge) -> DataFrame:
    """(id, direct, complete, only, relevant): three judgements of question and answer; null for abstentions."""
    asked = F.col("outcome") != "Abstain"
    cases = cases.withColumn("_said", F.when(asked, judge(F.col("question"), F.col("answer_text"))))
    said = {n: F.col("_said")[n] for n, _, _ in RELEVANCY}
    return cases.select("id", *(v.alias(n) for n, v in said.items())).withColumn("relevant", (F.col("direct") == "DIRECT") & (F.col("complete") == "COMPLETE") & (F.col("only") == "ONLY"))


def relevancy_aggregate(per: DataFrame) -> DataFrame:
    """One row: measured cases, relevant ones and their rate (null if none), and each conjunct's count."""
    return per.agg(F.count("relevant").alias("measured"), F.count_if("relevant").alias("relevant"), F.round(F.avg(F.col("relevant").cast("int")), 4).alias("rate"), *(F.count_if(F.col(n) == yes).alias(n) for n, yes, _ in RELEVANCY))


def parsed_relevancy(answer: Column) -> Column:
    """Struct of the three verdicts of an answer of exactly three non-blank lines, each in its vocabulary; else null."""
    from corpusloom.functions.text import VERDICT_TRIM, verdict

    lines = F.filter(F.split(answer, "\r\n|[\n\r]"), lambda x: F.btrim(x, F.lit(VERDICT_TRIM)) != "")
    said = [verdict(F.try_element_at(lines, F.lit(i + 1)), (yes, no)) for i, (_, yes, no) in enumerate(RELEVANCY)]
    ok = (F.size(lines) == 3) & said[0].isNotNull() & said[1].isNotNull() & said[2].isNotNull()
    return F.when(ok, F.struct(*(v.alias(n) for v, (n, _, _) in zip(said, RELEVANCY))))


def selected(cases: DataFrame, case_id: str | None = None, everything: bool = False) -> DataFrame:
    """The one named case, or all if asked for; neither is an error, as is an unknown id."""
    if everything:
        return cases
    if case_id is None:
        raise ValueError("name a case or ask for all of them")
    found = cases.where(F.col("id") == case_id)
    if not found.take(1):
        raise ValueError(f"there is no case {case_id!r}")
    return found
