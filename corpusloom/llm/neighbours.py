"""The k most similar vectors of every vector, by a block matrix join on quantised tiles.

Vectors are scaled to unit length and packed into blocks that hold an int8 image, its scales, and the norms
of what rounding lost, besides the floats. A task keeps one group of row blocks and streams all blocks of
the same index past it. A tile of int8 products gives each similarity with an error bound; a pair survives
if its upper bound reaches the row's k-th best so far. Survivors are recomputed in double precision and
merged into the row's k best, which raises the bar for the following tiles.

Equal vectors are one member of the join (their k + 1 smallest ids stand for them), so no crowd of copies
multiplies. With ``bound`` 1, the default, nothing is dropped: the result is exact within the stated rounding.
Below 1 only that share of the error bounds is honoured, which spares recomputation at a loss of accuracy that
the tests measure.

A tile multiplies the int8 codes as float32, whose sums of such products are exact in up to 1040 dimensions
(longer vectors are summed in float64): there is no faster int8 product in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import stage

#: Vectors of a block; rows of a tile computed at once; most blocks that one task keeps as rows.
BLOCK, STRIP, MOST_ROW_BLOCKS = 2048, 512, 64
#: Dimensions up to which sums of int8 products are whole numbers that float32 holds.
_WHOLE = (1 << 24) // 127**2


def usable_vectors(vectors: DataFrame, identity: DataFrame, index: str = "index_id", key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(index_id, vec_id, v): vectors of their index's dimension, finite and not all zero, one row per id.

    Rows without id or vector, and vectors of an index without identity, are not usable. Of different
    vectors under one id the least (as an array) counts.
    """
    # The identities are a fixed table of a row per index.
    dims = identity.select(F.col(index).alias("index_id"), F.col("dimension")).distinct()
    v = F.col("v")
    rows = vectors.select(F.col(index).alias("index_id"), F.col(key).alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.join(dims, "index_id").where((F.size(v) == F.col("dimension")) & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("index_id", "vec_id").agg(F.min("v").alias("v"))


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block: ids, float vectors, int8 codes of the unit vectors, their scales and rounding losses."""
    x = np.stack(rows["v"].to_numpy()).astype(np.float32)
    unit = _unit(x)
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return pd.DataFrame([{"index_id": key[0], "block": key[1], "dim": x.shape[1], "ids": rows["rep"].to_numpy(np.int64).tobytes(), "floats": x.tobytes(), "codes": codes.tobytes(), "scale": scale.tobytes(), "lost": lost.tobytes()}])


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component is divided out first, against under- and overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Block:
    """A block as arrays."""

    def __init__(self, row: dict):
        d = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.unit = _unit(np.frombuffer(row["floats"], np.float32).reshape(-1, d))
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(-1, d).astype(np.float32 if d <= _WHOLE else np.float64)
        self.scale = np.frombuffer(row["scale"])
        self.lost = np.frombuffer(row["lost"])


class Best:
    """The k best neighbours so far of every vector of a block."""

    def __init__(self, block: Block, k: int, digits: int, bound: float):
        self.block, self.k, self.digits, self.bound = block, k, digits, bound
        n = len(block.ids)
        self.sim = np.full((n, k), -np.inf)
        self.other = np.full((n, k), np.iinfo(np.int64).max)

    def meet(self, columns: Block) -> None:
        """Take in the tile of this block with ``columns``."""
        rows, eps = self.block, 0.6 * 10.0**-self.digits + 1e-5
        for at in range(0, len(rows.ids), STRIP):
            strip = slice(at, at + STRIP)
            # Products of int8 codes, each column then times its scale; the row scales go into the bar.
            tile = rows.codes[strip] @ columns.codes.T
            tile *= columns.scale.astype(tile.dtype)
            # |x.y - product| <= lost_y + lost_x (1 + lost_y), with lost_y at its largest in the block.
            most = columns.lost.max()
            slack = self.bound * (most + rows.lost[strip] * (1 + most)) + eps
            bar = self.sim[strip, -1]
            if np.isneginf(bar).any() and tile.shape[1] > self.k + 1:
                # Not yet k neighbours: the k-th best product (one more, for the vector itself) sets a first bar.
                kth = np.partition(tile, tile.shape[1] - self.k - 1, axis=1)[:, tile.shape[1] - self.k - 1] * rows.scale[strip] - slack
                bar = np.maximum(bar, kth)
            keep = tile >= ((bar - slack) / rows.scale[strip])[:, None].astype(tile.dtype)
            i, j = np.divmod(np.flatnonzero(keep), tile.shape[1])
            i += at
            other = rows.ids[i] != columns.ids[j]
            i, j = i[other], j[other]
            if len(i):
                self._merge(i, columns.ids[j], self._exact(i, columns, j))

    def _exact(self, i: np.ndarray, columns: Block, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at in range(0, len(i), 65_536):
            s = slice(at, at + 65_536)
            out[s] = np.einsum("ij,ij->i", self.block.unit[i[s]], columns.unit[j[s]])
        return np.round(out, self.digits)

    def _merge(self, i: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        touched = np.unique(i)
        i = np.r_[i, np.repeat(touched, self.k)]
        ids = np.r_[ids, self.other[touched].ravel()]
        sim = np.r_[sim, self.sim[touched].ravel()]
        order = np.lexsort((ids, -sim, i))
        i, ids, sim = i[order], ids[order], sim[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        take = (start[:, None] + np.arange(self.k)).ravel()  # every touched row has at least k entries
        self.other[touched] = ids[take].reshape(-1, self.k)
        self.sim[touched] = sim[take].reshape(-1, self.k)

    def rows(self, index_id: str) -> pd.DataFrame:
        n = len(self.block.ids)
        out = pd.DataFrame({"index_id": index_id, "rep": np.repeat(self.block.ids, self.k), "other": self.other.ravel(), "sim": self.sim.ravel(), "n": n})
        return out[np.isfinite(out["sim"])].drop(columns="n")


def _stream(k: int, digits: int, bound: float):
    columns = ["index_id", "role", "dim", "ids", "floats", "codes", "scale", "lost", "unit_of_work"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, held, index_id = None, [], None
        for frame in frames:
            for row in frame[columns].to_dict("records"):
                if row["unit_of_work"] != work:
                    yield from (b.rows(index_id) for b in held)
                    work, held, index_id = row["unit_of_work"], [], row["index_id"]
                if row["role"] == 0:
                    held.append(Best(Block(row), k, digits, bound))
                else:
                    block = Block(row)
                    for b in held:
                        b.meet(block)
        yield from (b.rows(index_id) for b in held)

    return run


def nearest(vectors: DataFrame, k: int = 10, digits: int = 6, block: int = BLOCK, bound: float = 1.0) -> DataFrame:
    """(index_id, vec_id, other_id, sim, rank): the k most similar others of each vector of its index.

    ``vectors`` is what ``usable_vectors`` gives. ``sim`` is the cosine rounded to ``digits``; of equally
    similar vectors the smaller id comes first. A vector with fewer than k others has them all. ``bound`` is the
    share of the error bounds that is honoured. Equal vectors are told by a 64-bit hash.

    Every group of row blocks sees all blocks of its index once, so what is shuffled is the vectors times the
    groups; groups are as large as the number of tasks permits, up to MOST_ROW_BLOCKS.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors.withColumn("h", F.xxhash64("v")), "vectors")
    classes = stage(vectors.groupBy("index_id", "h").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v")), "vector_classes")
    member = vectors.join(classes.drop("v"), ["index_id", "h"]).select("index_id", "rep", "vec_id")
    sizes = classes.groupBy("index_id").agg(F.count("*").alias("n"))
    dealt = classes.join(sizes, "index_id").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / block)).cast("int"))
    blocks = dealt.groupBy("index_id", "block").applyInPandas(_pack, "index_id string, block int, dim int, ids binary, floats binary, codes binary, scale binary, lost binary")
    blocks = stage(blocks, "vector_blocks")
    # A row per index, and there are as many as index_identity has.
    per_index = blocks.groupBy("index_id").agg((F.max("block") + 1).alias("nb"))
    whole = per_index.select(F.sum("nb")).first()[0] or 0
    slots = 2 * spark.sparkContext.defaultParallelism
    spread = F.lit(max(1, min(MOST_ROW_BLOCKS, -(-whole // slots))))
    held = blocks.join(per_index, "index_id").withColumn("g", F.floor(F.col("block") / spread).cast("int"))
    groups = F.ceil(F.col("nb") / spread).cast("int")
    rows = held.withColumn("role", F.lit(0)).withColumn("at", F.col("block"))
    # Streamed from a group's own blocks on, so the first tiles set its bars.
    past = blocks.join(per_index, "index_id").withColumn("g", F.explode(F.sequence(F.lit(0), groups - 1))).withColumn("role", F.lit(1)).withColumn("at", F.pmod(F.col("block") - F.col("g") * spread, F.col("nb")))
    both = rows.unionByName(past).withColumn("unit_of_work", F.concat_ws("/", "index_id", "g"))
    units = per_index.select(F.sum(groups)).first()[0] or 1
    tasks = both.repartitionByRange(int(min(units, 100_000)), "unit_of_work").sortWithinPartitions("unit_of_work", "role", "at")
    found = stage(tasks.mapInPandas(_stream(k, digits, bound), "index_id string, rep long, other long, sim double"), "neighbours")
    # Of a class, k + 1 ids can matter: a member itself may be one of them.
    first = Window.partitionBy("index_id", "rep").orderBy("vec_id")
    standing = member.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")
    own = standing.select("index_id", "rep", F.col("vec_id").alias("other_id"), F.lit(1.0).alias("sim"))
    others = found.join(standing.select("index_id", F.col("rep").alias("other"), F.col("vec_id").alias("other_id")), ["index_id", "other"]).select("index_id", "rep", "other_id", "sim")
    order = Window.partitionBy("index_id", "rep").orderBy(F.desc("sim"), "other_id")
    lists = own.unionByName(others).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = lists.groupBy("index_id", "rep").agg(F.array_sort(F.collect_list(F.struct("n", "other_id", "sim"))).alias("best"))  # k + 1 entries at most
    mine = member.join(lists, ["index_id", "rep"]).select("index_id", "vec_id", F.slice(F.filter("best", lambda b: b["other_id"] != F.col("vec_id")), 1, k).alias("best"))
    return mine.select("index_id", "vec_id", F.posexplode("best").alias("rank", "b")).select("index_id", "vec_id", F.col("b.other_id").alias("other_id"), F.col("b.sim").alias("sim"), (F.col("rank") + 1).alias("rank"))
