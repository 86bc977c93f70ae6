"""Connected components by hooking and contraction over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import stage


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, grp): the smallest class of each connected component.

    ``links`` has a and b, ``nodes`` cls (of the same type). In a round every class hooks to its smallest
    neighbour, hooks are followed to their ends by doubling, and the links are rewritten to those ends; links
    whose ends have met are dropped. Rewriting keeps what is connected connected, and of every component the
    greatest class is gone after a round, so the rounds end when no link is left: nothing is cut off. A chain
    of 1000 classes takes about seven rounds, a star two.

    Nulls in links are no links. Classes without links are their own group; links to classes that are not in
    ``nodes`` count as connections.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("to"))
        hook = stage(hook, "hooks")
        while True:
            further = hook.select(F.col("x").alias("to"), F.col("to").alias("next"))
            hook = stage(hook.join(further, "to").select("x", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")), "hooks")
            if not hook.where("moved").take(1):
                break
        end = lambda side: hook.select(F.col("x").alias(side), F.col("to").alias(f"{side}_to"))
        moved = edges.join(end("a"), "a").join(end("b"), "b").where("a_to <> b_to")
        edges = stage(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        maps.append(hook)
    if not maps:
        return nodes.select("cls", F.col("cls").alias("grp"))
    # Later maps are over what earlier ones lead to, and ever smaller: composed from the last one back.
    whole = maps.pop()
    while maps:
        later = whole.select(F.col("x").alias("to"), F.col("to").alias("next"))
        whole = maps.pop().join(later, "to", "left").select("x", F.coalesce("next", "to").alias("to"))
    return nodes.select("cls").join(whole.withColumnRenamed("x", "cls"), "cls", "left").select("cls", F.coalesce("to", "cls").alias("grp"))
