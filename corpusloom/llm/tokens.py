"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizers' vocabulary files; a parameter of every function that counts tokens.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoding(folder: str, name: str):
    """The byte-level BPE ``name`` (a .tiktoken file of ``folder``), loaded once per worker process."""
    path = f"{folder}/{name}.tiktoken"
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(name, pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


#: Longest run given to the tokenizer at once; it cuts only where the pattern splits anyway.
_STRIDE = 20_000


def count_tokens(text: str, encoder) -> int:
    """Tokens of ``text``. Very long texts are counted in stretches that end before a space after a letter,
    where the pattern splits in any case, so the sum is that of the whole."""
    if len(text) <= _STRIDE:
        return len(encoder.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = at + _STRIDE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end - 1].isascii() and text[end + 1 : end + 2].isalpha()):
            end += 1
        total += len(encoder.encode_ordinary(text[at:end]))
        at = end
    return total


def with_tokens(rows: DataFrame, text: str, keep: list[str], folder: str = TOKENIZERS, name: str = "byte_bpe_50k", out: str = "tokens") -> DataFrame:
    """``keep`` and the token count of ``text`` as ``out`` (BIGINT); null texts have 0 tokens.

    Only the text and ``keep`` travel to Python, and only numbers come back.
    """
    slim = rows.select(*keep, F.col(text).alias("_text"))
    fields = slim.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(folder, name)
        for batch in batches:
            sizes = [0 if t is None else count_tokens(t, encoder) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, out])

    return slim.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {out} long")
