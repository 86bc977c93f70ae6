"""Queries of problem 7: documents in containers of each token capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.packing import cut_to_capacity, fill_report, limits_for, pack, shards_for
from corpusloom.llm.tokens import with_tokens
from corpusloom.runtime import stage, table


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document, written once: counting is by far the dearest step."""
    return stage(with_tokens(table(spark, d, "documents"), "text", ["doc_id"]), "document_tokens")


def _packed(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    sizes = document_sizes(spark, d)
    # The limits are a fixed table of a few rows.
    limits = table(spark, d, "size_limits").where("unit = 'tokens'").select("limit_id", "max_size").collect()
    # Parts and tokens per capacity, in one pass.
    ask = {m: (f"coalesce(sum(ceil(tokens / {m})), 0) AS n{m}") for m in {r["max_size"] for r in limits}}
    seen = sizes.where("tokens > 0").selectExpr("coalesce(sum(tokens), 0) AS tokens", *ask.values()).first()
    out = []
    for r in limits:
        m, n = r["max_size"], seen[f"n{r['max_size']}"]
        items, cost = limits_for(m, n, seen["tokens"])
        out.append((r["limit_id"], m, pack(cut_to_capacity(sizes, "doc_id", "tokens", m), m, items, cost, shards=shards_for(n))))
    return out


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Which document (or part of one over the capacity) went into which container.

    A container holds at most the limit's tokens, five times the items that fill it on average, and 0.9 of the
    attention cost of one item that fills it (unless that item is alone).
    """
    frames = [p.select(F.lit(name).alias("limit_id"), F.lit(m).alias("capacity"), "container", F.col("item").alias("doc_id"), "part", F.col("part_start").alias("token_start"), F.col("part_size").alias("tokens")) for name, m, p in _packed(spark, d)]
    return reduce(DataFrame.unionByName, frames)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and their fill per capacity."""
    return reduce(DataFrame.unionByName, [fill_report(p, m).select(F.lit(name).alias("limit_id"), F.lit(m).alias("capacity"), "*") for name, m, p in _packed(spark, d)])


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
