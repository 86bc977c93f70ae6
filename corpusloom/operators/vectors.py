"""Exact nearest vectors of a stated set of query vectors, and the identity of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import stage

#: Rows that are multiplied at once, and of a query block: a product is 8 MB. A corpus block has up to eight times as many
#: rows, the fewer the longer the vectors: 4 MB, or those of one product.
CORPUS_BLOCK, QUERY_BLOCK = 4096, 256
_BLOCK_NUMBERS, _GROUP = 1 << 19, 32


def _block(name: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, np.float64) for v in rows["v"]])
        return pd.DataFrame([{"space": key[0], name: key[1], "ids": rows["id"].tolist(), "m": x.tobytes()}])

    return run


def _per_space(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(space, blocks): how many blocks of ``size`` rows (None: of the corpus) each space has; a row per space, as many as indexes."""
    of = F.lit(size) if size else F.greatest(F.lit(CORPUS_BLOCK), F.least(F.lit(8 * CORPUS_BLOCK), F.lit(_BLOCK_NUMBERS) / F.greatest(F.max(F.size("v")), F.lit(1))))
    return rows.groupBy("space").agg(F.ceil(F.count("*") / of).cast("int").alias("blocks"))


def _blocks(rows: DataFrame, name: str, per_space: DataFrame) -> DataFrame:
    dealt = rows.join(F.broadcast(per_space), "space").withColumn(name, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.groupBy("space", name).applyInPandas(_block(name), f"space string, {name} int, ids array<string>, m binary")


def _place_in_run(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value of a sorted array."""
    return np.arange(len(x)) - np.searchsorted(x, x)


def _best(q: np.ndarray, c: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of rows of q and c whose rounded products are among the k largest of the row of q, or equal to those, and the products."""
    sim = q @ c.T
    n, at = None, None
    if 0 < k * _GROUP <= len(c):
        # The k-th largest of the groups' largest is reached by k at least; what rounds to less than it does is left out.
        whole = len(c) // _GROUP * _GROUP
        tops = sim[:, :whole].reshape(len(q), _GROUP, -1).max(axis=1)
        if not np.isnan(tops).any():
            bar = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
            n, at = np.nonzero(sim >= (bar - 2 * 10.0**-digits)[:, None])
    if n is None:
        n, at = (x.ravel() for x in np.indices(sim.shape))
    return n, at, np.round(sim[n, at], digits)


def nearest_of(queries: DataFrame, corpus: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products, in double precision, rounded.

    Both frames have space (index; only equal ones meet), id (string) and v (array of numbers, all of one
    length within a space). The blocks of queries, the smaller side, are sent to every block of the corpus and
    joined by its number (sorted and merged: the planner takes them for as small as they were before they were
    sent, and would pass them through the driver), so every corpus block is a unit of work of its own; a pair of
    blocks keeps k candidates a query. Ties go to the smaller id. k below 1 gives nothing, k beyond the corpus all of it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q = np.frombuffer(row.qm).reshape(len(row.qids), -1)
                c = np.frombuffer(row.m).reshape(len(row.ids), -1)
                ids = np.asarray(row.ids, dtype=object)
                order = np.argsort(ids, kind="stable")
                parts = [_best(q, c[order[at : at + CORPUS_BLOCK]], k, digits) for at in range(0, len(order), CORPUS_BLOCK)]
                n, at, score = (np.concatenate(x) for x in zip(*((n, at + i * CORPUS_BLOCK, score) for i, (n, at, score) in enumerate(parts))))
                best = np.lexsort((at, -score, n))
                best = best[_place_in_run(n[best]) < k]
                yield pd.DataFrame({"query_id": np.asarray(row.qids, dtype=object)[n[best]], "id": ids[order[at[best]]], "score": score[best]})

    k = max(0, k)
    q = _blocks(queries, "qb", _per_space(queries, QUERY_BLOCK)).select("space", F.col("ids").alias("qids"), F.col("m").alias("qm"))
    q = q.join(F.broadcast(_per_space(corpus)), "space").select("space", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cb"), "qids", "qm")
    c = _blocks(corpus, "cb", _per_space(corpus))
    found = c.join(q.hint("merge"), ["space", "cb"]).mapInPandas(run, "query_id string, id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def semantic(queries: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the k texts whose embedding is nearest to each question's, by inner product.

    ``queries`` has query_id and question, ``corpus`` id and text. ``embed`` is the provider: a function from a text
    column to a column of numbers, such as a pandas UDF of a model, whose vectors are of one length.
    """
    one = lambda df, key, text: df.select(F.lit("e").alias("space"), F.col(key).alias("id"), embed(F.col(text)).alias("v"))
    return nearest_of(one(queries, "query_id", "question"), one(corpus, "id", "text"), k)


def corpus_fingerprint(rows: DataFrame, key: str, text: str, group: int = 1024) -> DataFrame:
    """One row (rows, fingerprint): a hash tree over all (key, text), whatever their order and partitioning.

    A leaf is the hash of key and text (null counts as empty) with the number of rows that have it. Leaves are
    dealt by their hash to nodes of about ``group``, a node hashes its sorted leaves, and ``group`` neighbouring
    nodes at a time are hashed together until one is left, so no group grows with the corpus. No rows give the
    hash of nothing.
    """
    hex_of = lambda c: F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256)
    leaves = rows.select(F.sha2(F.concat(hex_of(key), hex_of(text)), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    leaves = stage(leaves, "leaves")
    nodes = max(1, -(-leaves.count() // group))
    dealt = F.pmod(F.conv(F.left("h", F.lit(8)), 16, 10).cast("long"), F.lit(nodes))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))), lambda x: F.concat(x["h"], F.lit(":"), x["n"].cast("string")))
    tree = leaves.groupBy(dealt.alias("node")).agg(F.sum("n").alias("rows"), F.sha2(F.array_join(joined, ","), 256).alias("h"))
    while True:
        below = F.transform(F.array_sort(F.collect_list(F.struct("node", "h"))), lambda x: x["h"])
        nodes = -(-nodes // group)
        sums = (F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(below, ","), 256).alias("h"))
        if nodes == 1:
            return tree.agg(*sums).withColumnRenamed("h", "fingerprint")
        tree = tree.groupBy(F.floor(F.col("node") / group).alias("node")).agg(*sums)


# The signals of an index identity, in the order mismatches are named.
SIGNALS = ("model_id", "model_revision", "dimension", "index_type", "metric", "vector_count", "chunk_ids", "chunk_fingerprint", "document_hashes")


def identity_mismatches(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, mismatches): names of the differing signals of each index, in order; only signals in both frames."""
    names = [c for c in SIGNALS if c in stored.columns and c in expected.columns]
    x = stored.select(key, *(F.col(c).alias(f"s_{c}") for c in names)).join(expected.select(key, *(F.col(c).alias(f"e_{c}") for c in names)), key, "full_outer")
    return x.select(key, F.filter(F.array(*(F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"e_{c}")), F.lit(c)) for c in names)), lambda n: n.isNotNull()).alias("mismatches"))
