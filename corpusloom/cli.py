"""Ask one question of a chunk table: ``python -m corpusloom.cli --data DIR --question TEXT [--top-k N] [--route R]``."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import placeholder_embedding
from corpusloom.operators.assemble import answers, resolved
from corpusloom.operators.fusion import reciprocal_rank_fusion
from corpusloom.operators.lexical import bm25
from corpusloom.operators.vectors import semantic
from corpusloom.plans import inputs
from corpusloom.runtime import released, stage

ROUTES = ("fused", "lexical", "semantic")


def answer(spark: SparkSession, data: str, question: str, k: int = 5, route: str | None = None, embed: Callable[[Column], Column] | None = None) -> str:
    """The answer quoted from the k best chunks of a route, as one JSON document.

    With a model for ``embed`` the route is the fused one unless another is named. Without one it is the lexical
    one: the placeholder embedding, which the other routes then go by, knows no meaning and always finds something.
    """
    route, embed = route or ("fused" if embed else "lexical"), embed or placeholder_embedding
    with released():
        corpus = stage(inputs.corpus(spark, data), "corpus")
        asked = spark.createDataFrame([("q", question)], "query_id string, question string")
        routes = {"lexical": lambda: bm25(corpus, asked, k), "semantic": lambda: semantic(asked, corpus, embed, k)}
        found = routes[route]() if route in routes else reciprocal_rank_fusion(routes["semantic"](), routes["lexical"](), corpus, k)
        said = answers(asked, resolved(found, corpus))
        return said.select(F.to_json(F.struct("answer_text", "outcome", "statements"))).first()[0]


def main(argv: list[str] | None = None) -> int:
    """Parse arguments, print the answer; 2 on a blank question."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--question", required=True)
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--route", choices=ROUTES, default=None)
    a = p.parse_args(argv)
    if not a.question.strip():
        p.error("the question is blank")
    print(answer(SparkSession.builder.getOrCreate(), a.data, a.question, a.top_k, a.route))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
