"""Queries of problem 8: documents mixed to the target shares of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.mixing import block_plan, mixture, normal_source, source_blocks
from corpusloom.llm.tokens import with_tokens
from corpusloom.runtime import stage, table

#: Tokens of a block.
BLOCK = 1024


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("kind", normal_source(F.col("source")))
    sizes = stage(with_tokens(docs, "text", ["doc_id", "kind"]), "source_tokens")
    targets = table(spark, d, "mixture_targets").withColumn("source", normal_source(F.col("source")))
    # One row per target: a fixed, short list.
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    per = sizes.where(F.col("kind").isin(list(wanted)) & (F.col("tokens") > 0)).groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()
    plan = block_plan({r["kind"]: r["tokens"] for r in per}, wanted, BLOCK)
    blocks = source_blocks(sizes.where(F.col("kind").isin(list(plan))), "doc_id", "kind", "tokens", BLOCK, sum(r["docs"] for r in per))
    return mixture(blocks, plan), targets, sizes


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixed stream: for every shard and slot the fragments of documents that fill it."""
    mixed, _, _ = _mixed(spark, d)
    return mixed.withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source, with the tokens there were and the most any block is used."""
    mixed, targets, sizes = _mixed(spark, d)
    got = mixed.groupBy("source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), (F.max("epoch") + 1).alias("repeats"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    have = sizes.groupBy(F.col("kind").alias("source")).agg(F.sum("tokens").alias("available"))
    return (
        targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(got, "source", "left").join(whole)
        .select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("whole")), F.lit(0.0)).alias("share"))
    )


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
