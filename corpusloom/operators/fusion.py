"""Reciprocal rank fusion of two routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The rank constant, and the digits a fused score is reported with.
RANK_CONSTANT, DIGITS = 60, 6


def fused_candidates(semantic: DataFrame, lexical: DataFrame, authority: DataFrame | None = None, constant: int = RANK_CONSTANT) -> DataFrame:
    """All candidates with their rank: (query_id, id, semantic_rank, lexical_rank, score, rank).

    Routes have query_id, id and rank (1 is best; an id that is listed twice counts at its best rank). Ranks
    of an absent route are null. The order is by unrounded score down, then by ``authority`` (id, and the
    columns canon, source, chunk_index that order the corpus; ids it lacks come last), then by first
    appearance (semantic before lexical).
    """
    route = lambda df, name: df.groupBy("query_id", "id").agg(F.min("rank").alias("r")).select("query_id", "id", F.lit(name).alias("route"), "r")
    both = route(semantic, "s").unionByName(route(lexical, "l"))
    per = both.groupBy("query_id", "id").agg(F.max(F.when(F.col("route") == "s", F.col("r"))).alias("semantic_rank"), F.max(F.when(F.col("route") == "l", F.col("r"))).alias("lexical_rank"))
    part = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    scored = per.withColumn("exact", part("semantic_rank") + part("lexical_rank"))
    seen = F.coalesce("semantic_rank", F.lit(1 << 30) + F.col("lexical_rank"))
    keys = []
    if authority is not None:
        scored = scored.join(authority.select("id", "canon", "source", "chunk_index", F.lit(0).alias("covered")).hint("merge"), "id", "left")
        keys = [F.coalesce("covered", F.lit(1)), F.col("canon"), F.col("source"), F.col("chunk_index")]
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), *keys, seen, "id")
    return scored.select("query_id", "id", "semantic_rank", "lexical_rank", F.round("exact", DIGITS).alias("score"), F.row_number().over(order).alias("rank"))


def reciprocal_rank_fusion(semantic: DataFrame, lexical: DataFrame, authority: DataFrame | None = None, k: int = 5, constant: int = RANK_CONSTANT) -> DataFrame:
    """The first k fused candidates of each question; k below 1 gives nothing."""
    return fused_candidates(semantic, lexical, authority, constant).where(F.col("rank") <= k)


def route_agreement(semantic: DataFrame, lexical: DataFrame, fused: DataFrame) -> DataFrame:
    """One row: mean union and overlap of the two routes, questions with overlap, fused picks from each."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.collect_set("id").alias(name))
    x = ids(semantic, "s").join(ids(lexical, "l"), "query_id", "full_outer").join(ids(fused, "f"), "query_id", "full_outer")
    none = F.array().cast("array<string>")
    x = x.select("query_id", *(F.coalesce(c, none).alias(c) for c in "slf"))
    size = lambda a, b: F.size(F.array_intersect(a, b))
    return x.agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.size(F.array_union("s", "l"))), 2).alias("mean_union"),
        F.round(F.avg(size("s", "l")), 2).alias("mean_overlap"),
        F.count_if(size("s", "l") > 0).alias("with_overlap"),
        F.round(F.avg(size("f", "s")), 2).alias("fused_from_semantic"),
        F.round(F.avg(size("f", "l")), 2).alias("fused_from_lexical"),
    )
