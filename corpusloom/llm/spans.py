"""Long exact spans shared between records, by fixed-block anchors.

Non-overlapping blocks of every record (half the least span long, at multiples of that) are indexed, every
rolling window of the same length probes them, and what hits a block of another record is extended to the
full span. A span of the least length always holds a whole block of either record.

Sending every rolling window of a large table to its block would move each character ten times over. So
records meet by content first: each window of the least span is routed by its minimizer (the smallest hash
among its short grams), which equal windows share wherever they stand, and consecutive windows of one
minimizer travel together as one stretch of text. Stretches whose minimizer stands in a single record go
nowhere. Index, probes and extension then run on the stretches of a minimizer, within a task, or, where very
many stretches have one minimizer, as joins on the blocks. What moves grows in proportion to the input, and
nothing is broadcast.

Equal texts are one text throughout; records that share their whole text are found by its hash. A text that
only one record holds belongs to that record (``own``), so that what the texts of one record share with each
other does not count. Blocks and spans are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import stage

#: Code points hashed at once, and stretches compared at once: arrays of that size stay in a core's cache.
_SLICE, _CHUNK = 1 << 15, 1_000
#: Stretches under one minimizer that one task indexes and probes (of some 160 code points, at about 40 bytes of
#: arrays each: 400 MB); the blocks of more are joined across tasks.
CROWD = 1 << 16
#: Texts a task remembers, so as to route repeated ones once; forgetting them costs work, not results.
_REMEMBERED = 1 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE_BITS = np.uint64(20)
_PLACE = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def rolling(points: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all windows of each length over an array of code points, built up by doubling."""
    with np.errstate(over="ignore"):
        out: list[np.ndarray | None] = [None] * len(lengths)
        have = [0] * len(lengths)
        cur, n = _mix(points.astype(np.uint64) + np.uint64(1)), 1
        while n <= max(lengths):
            for i, length in enumerate(lengths):
                if length & n:
                    if out[i] is None:
                        out[i] = cur
                    else:
                        m = max(0, len(points) - have[i] - n + 1)
                        out[i] = out[i][:m] * _power(n) + cur[have[i] : have[i] + m]
                    have[i] += n
            m = max(0, len(points) - 2 * n + 1)
            cur = cur[:m] * _power(n) + cur[n : n + m]
            n *= 2
        return [_mix(h[: max(0, len(points) - length + 1)]) for h, length in zip(out, lengths)]


def _slices(texts: list[str | None], least: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, code points, starts) of texts at least ``least`` long, some of them at a time."""
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t is not None and len(t) >= least:
            rows.append(i)
            size += len(t)
            if size >= _SLICE:
                yield _points(texts, rows)
                rows, size = [], 0
    if rows:
        yield _points(texts, rows)


def _points(texts: list[str], rows: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return rows, points, np.cumsum([0, *(len(texts[i]) for i in rows)])


def stretches(points: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimizer, text, first, count): runs of consecutive windows of ``span`` with the same minimizer.

    ``first`` is the run's first window within its text. Works on any length: texts longer than 2^20 code
    points are cut where their windows are enumerated, with the overlap that keeps every window whole.
    """
    out = []
    for at in range(0, max(1, len(points) - span + 1), (1 << 20) - span):
        part = points[at : at + (1 << 20)]
        (grams,) = rolling(part, gram)
        width = span - gram + 1
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            low = np.minimum(low[: len(low) - n], low[n:])
            n *= 2
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
        place = (low & _PLACE).astype(np.int64)
        begin = np.arange(len(place)) + at
        text = np.searchsorted(starts, begin, side="right") - 1
        whole = begin + span <= starts[text + 1]
        new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])] if len(place) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        count = np.bincount(run, weights=whole, minlength=len(first)).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        keep = count > 0
        f = first[keep]
        out.append((grams[place[f]].view(np.int64), text[f], begin[f] - starts[text[f]], count[keep]))
        if at + (1 << 20) >= len(points):
            break
    return tuple(np.concatenate(c) for c in zip(*out))


def _router(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routed: set[int] = set()
        for b in batches:
            keys, own = b.column("txt").to_numpy(), b.column("own").to_numpy()
            texts = b.column("text").to_pylist()
            for i, key in enumerate(keys.tolist()):
                if key in routed:
                    texts[i] = None
                routed.add(key)
            if len(routed) > _REMEMBERED:
                routed.clear()
            for rows, points, starts in _slices(texts, span):
                sig, text, first, count = stretches(points, starts, span, gram)
                row = np.array(rows)[text]
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(keys[row]), pa.array(own[row]), pa.array(first * 1024 + count)], names=["sig", "txt", "own", "place"])

    return run


def _cutter(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, own, txt = b.column("text").to_pylist(), b.column("own").to_numpy(), b.column("txt").to_numpy()
            sigs, places = b.column("sigs"), b.column("places")
            edges = sigs.offsets.to_numpy() - sigs.offsets[0].as_py()
            sig, place = sigs.flatten().to_numpy(), places.flatten().to_numpy()
            first, count = place >> 10, place & 1023
            row = np.repeat(np.arange(len(texts)), np.diff(edges))
            for at in range(0, len(sig), 32_000):
                s = slice(at, at + 32_000)
                pieces = [texts[i][f : f + n + span - 1] for i, f, n in zip(row[s].tolist(), first[s].tolist(), count[s].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(sig[s]), pa.array(txt[row[s]]), pa.array(own[row[s]]), pa.array(first[s].astype(np.int32)), pa.array(pieces, pa.string())], names=["sig", "txt", "own", "first", "piece"])

    return run


def _reaches(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each element, whether its hash stands under another owner too."""
    order = np.argsort(hashes, kind="stable")
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    mixed = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(mixed, np.diff(np.r_[first, len(h)]))
    return out


def _held(points: np.ndarray, starts: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, piece, offset, reference): every rolling window of half the span, its piece and its offset in
    the text; anchors are 0 where a window would leave its piece, and ``reference`` are those of the blocks."""
    block = span // 2
    (anchors,) = rolling(points, block)
    piece = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))[: len(anchors)]
    at = np.arange(len(anchors), dtype=np.int32)
    offset = at + (first - starts[:-1]).astype(np.int32)[piece]
    anchors[at + block > starts[1:].astype(np.int32)[piece]] = 0
    return anchors, piece, offset, np.flatnonzero((offset % block == 0) & (anchors != 0))


def _open(hit: np.ndarray, starts: np.ndarray, span: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of the windows of ``span`` that lie in one piece and hold a hit."""
    seen = np.r_[0, np.cumsum(hit)]
    last = np.minimum(np.arange(n) + span - span // 2 + 1, len(hit))
    s = np.flatnonzero(seen[last] > seen[:n])
    piece = np.searchsorted(starts, s, side="right") - 1
    ok = s + span <= starts[piece + 1]
    return s[ok], piece[ok]


def shared_in(pieces: list[str], own: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of what each piece shares with pieces of other records: anchors, probes, extension."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    _, points, starts = _points(pieces, list(range(len(pieces))))
    anchors, piece, _, reference = _held(points, starts, first, span)
    if not len(reference):
        return none
    order = np.argsort(anchors[reference], kind="stable")
    keys, holder = anchors[reference][order], own[piece[reference]][order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    index, low, high = keys[begins], np.minimum.reduceat(holder, begins), np.maximum.reduceat(holder, begins)
    # Every rolling window probes the index, most of them in vain: a table of 16 bits of the keys tells those.
    table = np.zeros(1 << 16, bool)
    table[index & np.uint64(0xFFFF)] = True
    probe = np.flatnonzero(table[(anchors & np.uint64(0xFFFF)).astype(np.uint16)])
    slot = np.minimum(np.searchsorted(index, anchors[probe]), len(index) - 1)
    mine = own[piece[probe]]
    hit = np.zeros(len(anchors), bool)
    hit[probe] = (index[slot] == anchors[probe]) & ((low[slot] != mine) | (high[slot] != mine))
    if not hit.any():
        return none
    # A hit is extended to the spans around it, which hold if a span of another record is the same.
    (spans,) = rolling(points, span)
    start, p = _open(hit, starts, span, len(spans))
    if not len(start):
        return none
    ok = _reaches(spans[start], own[p])
    shared, p = start[ok], p[ok]
    if not len(shared):
        return none
    # Maximal repeats: runs of shared windows.
    new = np.r_[True, (np.diff(shared) != 1) | (np.diff(p) != 0)]
    a, b = shared[new], shared[np.r_[new[1:], True]]
    p = p[new]
    return p, a - starts[p] + first[p], b - starts[p] + first[p] + span


def _comparer(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            txt, own, first = (t.column(c).to_numpy() for c in ("txt", "own", "first"))
            p, a, b = shared_in(t.column("piece").to_pylist(), own, first.astype(np.int64), span)
            return pa.RecordBatch.from_arrays([pa.array(txt[p], pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["txt", "a", "b"])

        # Rows come sorted by minimizer; a chunk ends where a minimizer does.
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(at, _CHUNK)
                if n >= _CHUNK:
                    sig = batch.column("sig").to_numpy()
                    last = held[-1].column("sig")[-1].as_py()
                    cut = int(np.searchsorted(sig != last, True)) if sig[0] == last else 0
                    if cut < len(sig):
                        if cut:
                            held.append(batch.slice(0, cut))
                        yield flush(held)
                        held, n, batch = [], 0, batch.slice(cut)
                held.append(batch)
                n += batch.num_rows
        if n:
            yield flush(held)

    return run


def _prober(span: int):
    """(anchor, txt, own, at, block) of every rolling window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                _, points, starts = _points(part.column("piece").to_pylist(), list(range(part.num_rows)))
                anchors, piece, offset, reference = _held(points, starts, part.column("first").to_numpy().astype(np.int64), span)
                block = np.zeros(len(anchors), bool)
                block[reference] = True
                ok = np.flatnonzero(anchors)
                row = piece[ok]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[ok].view(np.int64)), *(pa.array(part.column(c).to_numpy()[row]) for c in ("txt", "own")), pa.array(offset[ok].astype(np.int32)), pa.array(block[ok])], names=["anchor", "txt", "own", "at", "block"])

    return run


def _extender(span: int):
    """(span, txt, own, a) of every window of the span that holds a hit of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                _, points, starts = _points(part.column("piece").to_pylist(), list(range(part.num_rows)))
                first = part.column("first").to_numpy().astype(np.int64)
                hits = part.column("hits")
                edges = hits.offsets.to_numpy()
                # A text's hits, as places of this piece.
                row = np.repeat(np.arange(part.num_rows), np.diff(edges))
                place = hits.flatten().to_numpy() + (starts[:-1] - first)[row]
                hit = np.zeros(len(points), bool)
                hit[place[(place >= starts[row]) & (place + span // 2 <= starts[row + 1])]] = True
                (spans,) = rolling(points, span)
                s, p = _open(hit, starts, span, len(spans))
                yield pa.RecordBatch.from_arrays([pa.array(spans[s].view(np.int64)), *(pa.array(part.column(c).to_numpy()[p]) for c in ("txt", "own")), pa.array((s - starts[p] + first[p]).astype(np.int32))], names=["span", "txt", "own", "a"])

    return run


def _of_others(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("own").alias("low"), F.max("own").alias("high"))


def shared_spans(texts: DataFrame, span: int = 120, gram: int = 32, crowd: int | None = None) -> DataFrame:
    """(txt, a, b): stretches of each text, half-open in code points, that stand in a text of another record too.

    ``texts`` has txt (BIGINT, the hash of the text), own (BIGINT, whose text it is) and text, repeated as they
    come. Stretches of one text may touch or overlap; their union is all of the text that lies in spans of
    ``span`` or more shared with another record. ``crowd`` is how many stretches of one minimizer a task takes.
    """
    sigs = texts.where(F.length("text") >= span).select("txt", "own", "text").mapInArrow(_router(span, gram), "sig long, txt long, own long, place long")
    crowded = F.col("n") > (CROWD if crowd is None else crowd)
    met = sigs.groupBy("sig").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n")).where("low <> high").select("sig", crowded.alias("crowded"))
    places = sigs.drop("own").join(met.hint("merge"), "sig").groupBy("txt").agg(F.collect_set(F.struct("sig", "place", "crowded")).alias("met"))  # of one text: bounded by its length
    places = stage(places, "places")
    some = lambda crowded: places.select("txt", F.filter("met", lambda m: m["crowded"] == crowded).alias("met")).where(F.size("met") > 0).select("txt", F.col("met.sig").alias("sigs"), F.col("met.place").alias("places"))
    # Copies of a text are combined before they are shuffled; the join then finds them in place.
    once = texts.groupBy("txt").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    stretch = lambda of: once.join(of.hint("merge"), "txt").mapInArrow(_cutter(span), "sig long, txt long, own long, first int, piece string")
    near = stretch(some(False)).repartition("sig").sortWithinPartitions("sig").mapInArrow(_comparer(span), "txt long, a int, b int")
    # Minimizers of very many stretches (boilerplate): the same steps as joins, each combined before its shuffle.
    # As a table its size is known; where few texts have them, the planner need not shuffle the others.
    crowd_of = stage(some(True), "crowded_places")
    if not crowd_of.take(1):
        return near
    those = texts.join(crowd_of, "txt").groupBy("txt").agg(*(F.first(c).alias(c) for c in ("text", "own", "sigs", "places")))
    pieces = stage(those.mapInArrow(_cutter(span), "sig long, txt long, own long, first int, piece string").drop("sig"), "crowded_stretches")
    probes = pieces.mapInArrow(_prober(span), "anchor long, txt long, own long, at int, block boolean")
    index = _of_others(probes.where("block"), "anchor")
    hits = probes.select("anchor", "txt", "own", "at").join(index, "anchor").where("low <> own OR high <> own").groupBy("txt").agg(F.collect_set("at").alias("hits"))  # of one text
    spans = stage(pieces.join(hits, "txt").mapInArrow(_extender(span), "span long, txt long, own long, a int"), "extended")
    common = _of_others(spans, "span").where("low <> high").select("span")
    far = spans.join(common, "span", "left_semi").select("txt", "a", (F.col("a") + span).alias("b")).distinct()
    return near.unionByName(far)


def merged(stretches_: DataFrame) -> DataFrame:
    """(txt, spans, covered): how many separate stretches of each text are shared, and their total length."""
    w = Window.partitionBy("txt").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = stretches_.distinct().withColumn("before", before)
    return new.groupBy("txt").agg(
        F.count_if(F.col("before").isNull() | (F.col("a") > F.col("before"))).alias("spans"),
        F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("before", F.col("a"))))).alias("covered"),
    )


def shared_records(records: DataFrame, span: int = 120, crowd: int | None = None) -> DataFrame:
    """(record_table, record_id, n_chars, spans, covered, share): records with text that stands in another one.

    ``records`` has record_table, record_id and text. Null ids and texts and texts shorter than ``span`` have
    no shared span. Rows repeated under one table and id are one record if they carry the same text; with
    different texts, each is a text of that record, what they share among themselves does not count, and the
    longest shared length of them is reported.
    """
    rows = records.where(F.col("record_id").isNotNull() & (F.length("text") >= span)).withColumn("txt", F.xxhash64("text"))
    holders = rows.groupBy("record_table", "record_id", "txt").agg(F.max(F.length("text")).alias("n_chars"))
    holders = stage(holders, "holders")
    copies = holders.groupBy("txt").agg(F.count("*").alias("copies"))
    # The texts of records with several: one that no other record holds is that record's own.
    several = holders.groupBy("record_table", "record_id").agg(F.count("*").alias("texts")).where("texts > 1").drop("texts")
    theirs = holders.join(several, ["record_table", "record_id"]).join(copies.where("copies = 1"), "txt").select("txt", F.xxhash64("record_table", "record_id").alias("holder"))
    # Mostly few: as a table its size is known, and the planner need not shuffle the texts for it unless it is large.
    theirs = stage(theirs, "own_texts")
    texts = rows.select("txt", "text").join(theirs, "txt", "left").select("txt", F.coalesce("holder", "txt").alias("own"), "text")
    parts = merged(shared_spans(texts, span, crowd=crowd))
    found = holders.join(copies, "txt").join(parts, "txt", "left")
    whole = F.col("copies") > 1
    covered = F.when(whole, F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", F.lit(0).cast("long")))
    found = found.select("record_table", "record_id", "n_chars", F.when(whole, F.lit(1).cast("long")).otherwise(F.col("spans")).alias("spans"), covered.alias("covered")).where("covered > 0")
    best = found.groupBy("record_table", "record_id").agg(F.max(F.struct("covered", "n_chars", "spans")).alias("x"))
    return best.select("record_table", "record_id", "x.n_chars", "x.spans", "x.covered", (F.col("x.covered") / F.col("x.n_chars")).alias("share"))
