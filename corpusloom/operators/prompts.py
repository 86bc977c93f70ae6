"""Prompts for a judge or an answering model, as column expressions.

Every prompt takes only what its judgement may see: its placeholders are its arguments, and there is no way to
hand it ground truth or an answer's own evidence besides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prompts, with their arguments in braces; replies are read by ``text.verdict``, ``text.claims`` and
#: ``judged.parsed_relevancy``.
TEMPLATES = {
    "relevance": "Question:\n{question}\n\nPassage:\n{passage}\n\nDoes the passage help to answer the question? Reply with one word: RELEVANT or NOT_RELEVANT.",
    "reference_claims": "Text:\n{reference}\n\nBreak the text into its separate claims. Write one claim a line and nothing else.",
    "attribution": "Claim:\n{claim}\n\nContext:\n{context}\n\nCan the claim be taken from the context alone? Reply with one word: SUPPORTED or NOT_SUPPORTED.",
    "answer_claims": "Question:\n{question}\n\nAnswer:\n{answer}\n\nBreak the answer into the separate claims it makes. Write one claim a line and nothing else.",
    "support": "Claim:\n{claim}\n\nContext:\n{context}\n\nWhat does the context say of the claim? Reply with one word: SUPPORTED, PARTIALLY_SUPPORTED, CONTRADICTED or NOT_SUPPORTED.",
    "grounding": "Claim:\n{claim}\n\nPassage:\n{passage}\n\nDoes this passage by itself carry the claim? Reply with one word: SUPPORTED or NOT_SUPPORTED.",
    "relevancy": "Question:\n{question}\n\nAnswer:\n{answer}\n\nReply with three lines. First DIRECT or NOT_DIRECT: does the answer address the question? Then COMPLETE or NOT_COMPLETE: does it answer all of it? Then ONLY or NOT_ONLY: does it keep to it?",
    "answering": "Use nothing but the context to answer. If it does not hold the answer, say so.\n\nContext:\n{context}\n\nQuestion:\n{question}",
}


def prompt(name: str, **arguments: Column) -> Column:
    """The prompt ``name`` over its arguments, all of which and no others must be given; a null one gives null."""
    parts = re.split(r"\{(\w+)\}", TEMPLATES[name])
    wanted = set(parts[1::2])
    if set(arguments) != wanted:
        raise ValueError(f"the prompt {name} takes {', '.join(sorted(wanted))}")
    return F.concat(*(arguments[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))
