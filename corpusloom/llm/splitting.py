"""Cutting oversized items at natural boundaries by agglomerative merging.

An item is first cut into atomic segments at every natural boundary (blank line, line end, sentence end,
clause mark, space; where a stretch has none, hard cuts). Adjacent segments sit in a heap ordered by the
strength of the boundary between them; the weakest boundary is merged first, as long as the merged size
plus the overlap stays within the limit. What is left are the pieces; each but the first is then prefixed
with the last ``overlap`` code points before it.

Only items over the limit leave the JVM, and only offsets come back; piece texts are cut by Spark.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths; a higher one is kept longer.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, NONE = 5, 4, 3, 2, 1, 0

# A boundary stands after the matched run. Runs of marks are entered at their beginning only and given up whole,
# so that leader dots take time in proportion to their length.
_BOUNDARY = re.compile(
    r"(?P<paragraph>(?:\r\n|[\n\r\u2028\u2029\x85])[^\S\n\r]*(?:\r\n|[\n\r\u2028\u2029\x85])\s*)"
    r"|(?P<line>(?:\r\n|[\n\r\u2028\u2029\x85\x0b\x0c])[^\S\n\r]*)"
    r"|(?P<sentence>(?:(?<![.!?…])[.!?…]++[\"'”’»)\]]*+\s+)|(?:[。！？｡]+[」』）”]*\s*))"
    r"|(?P<clause>(?:[;:,]\s+)|(?:[、，；：]\s*))"
    r"|(?P<space>\s+)"
)
_STRENGTH = {"paragraph": PARAGRAPH, "line": LINE, "sentence": SENTENCE, "clause": CLAUSE, "space": SPACE}


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a character from its combining marks or joiner."""
    import unicodedata

    c = text[at]
    return bool(unicodedata.combining(c)) or c in "\u200d\ufe0f" or text[at - 1] == "\u200d"


def atoms(text: str, room: int) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments, and the strength of the boundary before each (the first: NONE).

    Sentences are the atoms; only one longer than ``room`` is cut further, at clauses, then spaces, then
    hard, never between a character and its combining marks unless those alone exceed ``room``.
    """
    coarse, fine = [(0, NONE)], []
    for m in _BOUNDARY.finditer(text):
        if m.end() < len(text) and m.end() > 0:
            s = _STRENGTH[m.lastgroup]
            (coarse if s >= SENTENCE else fine).append((m.end(), s))
    starts, strengths, k = [], [], 0
    for i, (at, s) in enumerate(coarse):
        end = coarse[i + 1][0] if i + 1 < len(coarse) else len(text)
        starts.append(at)
        strengths.append(s)
        while k < len(fine) and fine[k][0] <= at:
            k += 1
        if end - at <= room:
            continue
        inner = []
        while k < len(fine) and fine[k][0] < end:
            inner.append(fine[k])
            k += 1
        for nxt, s2 in [*inner, (end, NONE)]:
            last = starts[-1]
            while nxt - last > room:  # no boundary for longer than a piece may be
                cut = last + room
                while cut > last + 1 and _joined(text, cut):
                    cut -= 1
                if cut <= last + 1:
                    cut = last + room
                starts.append(cut)
                strengths.append(NONE)
                last = cut
            if nxt < end:
                starts.append(nxt)
                strengths.append(s2)
    return starts, strengths


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open code-point spans of the pieces of ``text``; the whole text if it is within ``limit``."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    room = limit - overlap
    starts, strengths = atoms(text, room)
    count = len(starts)
    end = [*starts[1:], n]
    following, before, alive = list(range(1, count + 1)), list(range(-1, count - 1)), [True] * count
    heap = [(strengths[i], end[i] - starts[i - 1], i) for i in range(1, count)]
    heapq.heapify(heap)
    while heap:
        strength, size, right = heapq.heappop(heap)
        if not alive[right]:
            continue
        left = before[right]
        now = end[right] - starts[left]
        # The first piece has no overlap to carry.
        if now > (limit if left == 0 else room):
            continue  # sizes only grow: this boundary stays
        if now != size:
            heapq.heappush(heap, (strength, now, right))
            continue
        alive[right] = False
        end[left] = end[right]
        following[left] = following[right]
        if following[right] < count:
            before[following[right]] = left
    spans, i = [], 0
    while i < count:
        spans.append((starts[i] - (overlap if i else 0), end[i]))
        i = following[i]
    return spans


_SPANS = "array<struct<start:int,end:int>>"


def _cutter(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in cut(t, limit, overlap)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_key"), batch.column("text"), pa.array(spans, type=kind)], names=["item_key", "text", "spans"])

    return run


def split_oversized(items: DataFrame, key: str, text: str, limit: int, overlap: int, newest: str | None = None) -> DataFrame:
    """Pieces of every item longer than ``limit`` code points.

    Columns: item_key (string), piece_index, piece_start, piece_end (code points, half-open), piece_text.
    Null, empty and fitting texts yield nothing. Rows repeated under one key count once: the row with the
    latest ``newest`` (then the greatest text) is cut. Pieces cover the item without gaps; each is at most
    ``limit`` long and, after the first, begins with the last ``overlap`` code points of what precedes it.
    Other columns of ``items`` are ignored, whatever their names.
    """
    order = F.col(newest) if newest else F.lit(0)
    # Oversized rows are picked before anything is shuffled; duplicates of one key then meet by key.
    large = items.where(F.length(F.col(text)) > limit).select(F.col(key).cast("string").alias("item_key"), F.col(text).alias("text"), order.alias("at"))
    large = large.groupBy("item_key").agg(F.max_by("text", F.struct("at", "text")).alias("text"))
    spans = large.mapInArrow(_cutter(limit, overlap), f"item_key string, text string, spans {_SPANS}")
    return spans.select("item_key", "text", F.posexplode("spans").alias("piece_index", "s")).select(
        "item_key", "piece_index", F.col("s.start").alias("piece_start"), F.col("s.end").alias("piece_end"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("piece_text")
    )
