"""Mixing sources to target weights with capped repetition.

Each source's documents are laid end to end in pseudorandom order and ruled into blocks of a fixed number of
tokens. The largest total at which every source that has text meets its target within its cap fixes the
blocks each source supplies. The source counts of every output shard are a multinomial draw conditioned on
those totals, so the shares hold exactly over all shards and vary within them as free draws would; they are
drawn slot by slot, by a keyed permutation of all slots, in the tasks. A slot's ordinal within its source goes
through a keyed permutation of that source's block numbers, one per epoch, and slots are joined to blocks by
number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents whose running token sum one window task computes, and slots that one task draws.
DOCS_PER_BUCKET, SLOTS_PER_TASK = 50_000, 1 << 18


def normal_source(source: Column) -> Column:
    """Source names without regard to case, and with any run of other characters as one underscore."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[^\p{L}\p{N}]+", "_")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of ``range(size)`` at ``index``: a four-round Feistel network, walked along its
    cycle until it lands inside the range."""
    index, size = index.astype(np.uint64), size.astype(np.uint64)
    key = key.astype(np.int64).view(np.uint64)
    half = np.uint64(1)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2)).astype(np.uint64)
    mask = (half << bits) - half
    out, left = index.copy(), np.ones(len(index), dtype=bool)
    with np.errstate(over="ignore"):
        while left.any():
            lo, hi, b, m, k = out[left] & mask[left], out[left] >> bits[left], bits[left], mask[left], key[left]
            for r in range(4):
                f = (lo + k + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                lo, hi = hi ^ ((f ^ (f >> np.uint64(29))) & m), lo
            out[left] = (hi << b) | lo
            left &= out >= size
    return out.astype(np.int64)


def source_blocks(sizes: DataFrame, key: str, source: str, tokens: str, block: int, n_docs: int) -> DataFrame:
    """(source, index, doc, token_start, token_end): the fragments of documents in each block."""
    docs = sizes.where(F.col(tokens) > 0).select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(tokens).alias("n"), F.xxhash64(key).alias("h"))
    docs = docs.withColumn("bucket", F.pmod("h", F.lit(max(1, -(-n_docs // DOCS_PER_BUCKET)))))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n").alias("s"))
    base = sums.withColumn("base", F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).drop("s")
    run = Window.partitionBy("source", "bucket").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("end", F.sum("n").over(run)).join(base, ["source", "bucket"]).select("source", "doc", "n", (F.col("base") + F.col("end") - F.col("n")).alias("at"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block)
    frag = placed.select("*", F.explode(F.sequence(first, last)).alias("index"))
    return frag.select(
        "source", "index", "doc",
        F.greatest(F.lit(0).cast("long"), F.col("index") * block - F.col("at")).alias("token_start"),
        F.least(F.col("n"), (F.col("index") + 1) * block - F.col("at")).alias("token_end"),
    )


def block_plan(available: dict[str, int], targets: dict[str, tuple[float, int]], block: int, total: int | None = None) -> dict[str, tuple[int, int]]:
    """{source: (its blocks, slots to fill)} for ``{source: tokens}`` and ``{source: (share, most repeats)}``.

    Without ``total`` the mixture is the largest in which every source that has text meets its target. A
    source that cannot supply its part of a given ``total`` supplies all it may.
    """
    have = {s: available.get(s, 0) for s in targets}
    wanted = {s: x for s, (x, _) in targets.items() if x and x > 0}
    usable = {s: x for s, x in wanted.items() if have[s] > 0 and targets[s][1] > 0}
    if not usable:
        return {}
    goal = total if total is not None else min(have[s] * targets[s][1] / x for s, x in usable.items())
    plan = {}
    for s, x in usable.items():
        blocks = -(-have[s] // block)
        # The last block is short; slots are counted in full blocks' worth of the source's mean block.
        mean = have[s] / blocks
        plan[s] = (blocks, max(0, min(round(goal * x / mean), blocks * targets[s][1])))
    return plan


def _mixed_key(*parts: np.ndarray | int) -> np.ndarray:
    key = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in parts:
            key = (np.asarray(x).astype(np.int64).view(np.uint64) + key) * np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            key = key ^ (key >> np.uint64(32))
    return key.view(np.int64)


def drawn_slots(at: np.ndarray, plan: dict[str, tuple[int, int]], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, epoch, index) of the slots at ``at``, out of all slots of ``plan``; source as a place in sorted names.

    A keyed permutation of all slots is a draw without replacement from the sources' totals: the counts of any
    shard are those of a multinomial conditioned on the totals. A slot's ordinal within its source goes
    through a permutation of that source's blocks, another one in every epoch.
    """
    import xxhash

    names = sorted(plan)
    blocks, slots = (np.array([plan[s][i] for s in names], np.int64) for i in (0, 1))
    ends = np.cumsum(slots)
    drawn = permuted(at, np.full(len(at), ends[-1]), np.full(len(at), _mixed_key(seed)))
    source = np.searchsorted(ends, drawn, side="right")
    ordinal = drawn - (ends - slots)[source]
    own = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed & 0xFFFF) for s in names], np.uint64).view(np.int64)
    epoch = ordinal // blocks[source]
    return source, epoch, permuted(ordinal % blocks[source], blocks[source], _mixed_key(own[source], epoch))


def mixture(blocks: DataFrame, plan: dict[str, tuple[int, int]], slots_per_shard: int = 4096, seed: int = 7) -> DataFrame:
    """(shard, slot, source, epoch, index, doc, token_start, token_end): the mixed stream by fragment.

    ``plan`` has a row per source; an empty one gives no rows. Every task draws its own slots, of any number.
    """
    spark = blocks.sparkSession
    plan = {s: x for s, x in plan.items() if x[1] > 0}
    total = sum(n for _, n in plan.values())
    names = np.array(sorted(plan), dtype=object)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                at = x["id"].to_numpy()
                source, epoch, index = drawn_slots(at, plan, seed)
                yield pd.DataFrame({"shard": at // slots_per_shard, "slot": at % slots_per_shard, "source": names[source], "epoch": epoch, "index": index})

    slots = spark.range(0, total, 1, max(1, -(-total // SLOTS_PER_TASK)))
    placed = slots.mapInPandas(place, "shard long, slot long, source string, epoch long, index long")
    # The planner knows the numbers of the slots, not what they become; never broadcast them.
    return placed.join(blocks.hint("merge"), ["source", "index"]).select("shard", "slot", "source", "epoch", "index", "doc", "token_start", "token_end")
