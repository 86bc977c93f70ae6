"""Positional identifiers and the placeholder embedding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components of the placeholder embedding.
PLACEHOLDER_DIMENSION = 16


def document_id(source: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256 of a document's path."""
    return F.left(F.sha2(source, 256), F.lit(12))


def chunk_id(document: Column, index: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of ``document:index``."""
    return F.left(F.sha2(F.concat_ws(":", document, index.cast("string")), 256), F.lit(16))


def placeholder_embedding(text: Column) -> Column:
    """16 components in [0, 1): the SHA-256 of the text, two bytes each, big-endian, over 65536."""
    digest = F.sha2(text, 256)
    part = lambda i: F.conv(F.substring(digest, i * 4 + 1, 4), 16, 10).cast("double") / F.lit(65536.0)
    return F.array(*(part(i) for i in range(PLACEHOLDER_DIMENSION)))


def canonical_rank(canonical: Column) -> Column:
    """0 for canonical, 1 for others and unknown."""
    return F.when(canonical, 0).otherwise(1)
