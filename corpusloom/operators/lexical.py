"""BM25 over a corpus for a batch of questions.

The corpus is packed once into blocks of posting lists, where it lies, and the questions into blocks of term
numbers; those, the smaller side, are sent to every block of the corpus by a shuffle (never by way of the driver),
and a task adds up the posting lists of a question's terms in arrays as long as its block. Only the k best of a
block leave it. No match is ever a row, so frequent terms cost an addition each and no key is hot. Scores are
summed as integers of 10^-12, so they do not depend on partitioning. Terms go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.runtime import stage

# The scoring parameters and the digits of a score.
K1, B, DIGITS = 1.2, 0.75, 6
_UNIT = 1_000_000_000_000
_HALF = _UNIT // 10**DIGITS // 2
#: Texts and tokens of a block of the corpus at most (a text's place in its block has 16 bits), and questions of a block.
BLOCK, BLOCK_TOKENS, QUERY_BLOCK = 32768, 4_000_000, 512
#: Texts of a slice that is added to a block as a whole; places are grouped by so many where the best are looked for.
_SLICE, _GROUP = 1024, 64


def term_frequencies(corpus: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf): occurrences of each token in each text."""
    return corpus.select(F.col(key).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df): texts that hold each term."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, total, avgdl): texts, tokens and mean length; texts without tokens count."""
    size = F.size(tokens(F.col(text)))
    return corpus.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total")).withColumn("avgdl", F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("n")), F.lit(0.0)))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): the tokens of each question with their multiplicity."""
    return queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)), positive for any df."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


_PLACE = ("canon", "source", "chunk_index", "id")
_PACKED = "blk long, n int, total long, canon array<int>, source array<string>, chunk_index array<int>, id array<string>, dl binary, terms binary, starts binary, docs binary, tfs binary"
_ASKED = "query_id array<string>, ns binary, h binary, weight binary, at binary, times binary"


def _signed_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64).view(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to posting lists, by the texts' place in the corpus, so that ties fall to the lower number."""
    from pyspark import TaskContext

    made, held, n, size = TaskContext.get().partitionId() << 32, [], 0, 0

    def block(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in _PLACE], null_placement="at_start"))
        tokens_ = pc.list_flatten(t.column("t")).combine_chunks().dictionary_encode()
        tokens_ = tokens_ if isinstance(tokens_, pa.DictionaryArray) else tokens_.combine_chunks()
        dl = pc.list_value_length(t.column("t")).to_numpy().astype(np.int64)
        hashes = _signed_hashes(tokens_.dictionary.to_pylist())
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key, tf = np.unique(rank[tokens_.indices.to_numpy()] * t.num_rows + np.repeat(np.arange(t.num_rows), dl), return_counts=True)
        term, doc = np.divmod(key, max(1, t.num_rows))
        starts = np.searchsorted(term, np.arange(len(order) + 1))
        raw = [x.tobytes() for x in (dl.astype(np.int32), hashes[order], starts.astype(np.int32), doc.astype(np.uint16), tf.astype(np.int32))]
        places = [pa.array([t.column(c).to_pylist()], pa.list_(kind)) for c, kind in zip(_PLACE, (pa.int32(), pa.string(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([t.num_rows], pa.int32()), pa.array([int(dl.sum())]), *places, *(pa.array([x], pa.binary()) for x in raw)], names=[f.split(" ")[0] for f in _PACKED.split(", ")])

    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            part = whole.slice(at, _SLICE)
            more = pc.sum(pc.list_value_length(part.column("t"))).as_py() or 0
            if n and (n + part.num_rows > BLOCK or size + more > BLOCK_TOKENS):
                yield block(held, made)
                made, held, n, size = made + 1, [], 0, 0
            held.append(part)
            n, size = n + part.num_rows, size + more
    if n:
        yield block(held, made)


def _pack_questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions to blocks: the distinct terms' hashes and weights, and each question's terms by number."""
    for whole in batches:
        for at in range(0, whole.num_rows, QUERY_BLOCK):
            part = whole.slice(at, QUERY_BLOCK)
            flat = part.column("terms").flatten()
            h, first, number = np.unique(flat.field("h").to_numpy(), return_index=True, return_inverse=True)
            raw = (pc.list_value_length(part.column("terms")).to_numpy().astype(np.int32), h, flat.field("weight").to_numpy()[first], number.astype(np.int32), flat.field("times").to_numpy().astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([part.column("query_id").to_pylist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], names=[f.split(" ")[0] for f in _ASKED.split(", ")])


class _Postings:
    """A packed block as arrays, and what its terms add to the score, where they have been asked for.

    A term in more than an eighth of the texts adds an array over all of them. Arrays over the texts are as long as
    ``padded``, a multiple of ``_GROUP``.
    """

    def __init__(self, row: dict, avgdl: float):
        self.n, self.place = row["n"], [row[c] for c in _PLACE]
        self.padded = -(-self.n // _GROUP) * _GROUP
        dl = np.frombuffer(row["dl"], np.int32)
        self.norm = K1 * (1 - B + B * (dl / avgdl if avgdl > 0 else np.zeros(self.n)))
        self.terms, self.starts = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["starts"], np.int32)
        self.docs, self.tfs = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["tfs"], np.int32)
        self.kept: dict[tuple[int, int], tuple[np.ndarray | None, np.ndarray]] = {}

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the terms' lists are; -1 for terms that the block does not have."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def gains(self, at: int, weight: float, times: int) -> tuple[np.ndarray | None, np.ndarray]:
        """The texts that have a term and what it adds to them; without texts, what it adds to all."""
        if (at, times) not in self.kept:
            s = slice(self.starts[at], self.starts[at + 1])
            docs, tf = self.docs[s].astype(np.intp), self.tfs[s]
            gain = np.rint(times * (weight * tf * (K1 + 1) / (tf + self.norm[docs])) * _UNIT).astype(np.int64)
            if len(docs) > self.n // 8:
                whole = np.zeros(self.padded, np.int64)
                whole[docs] = gain
                docs, gain = None, whole
            self.kept[at, times] = docs, gain
        return self.kept[at, times]

    def best(self, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best texts, of equal scores the first in the corpus, and their scores in units of the last digit."""
        least = 1
        if len(units) >= k * _GROUP:
            # The k-th best of the groups' best is reached by k texts at least.
            tops = units.reshape(_GROUP, -1).max(axis=0)
            bar = np.partition(tops, len(tops) - k)[len(tops) - k]
            least = max(1, (bar + _HALF) // (2 * _HALF) * 2 * _HALF - _HALF)
        found = np.flatnonzero(units >= least)
        score = (units[found] + _HALF) // (2 * _HALF)
        kept = np.argsort(-score, kind="stable")[:k]
        return found[kept], score[kept]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            starts = np.frombuffer(row["starts"], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["terms"], np.int64)), pa.array(np.diff(starts).astype(np.int64))], names=["h", "df"])


_FOUND = "query_id string, canon int, source string, chunk_index int, id string, score double, hits string, n long"


def _scorer(k: int, avgdl: float):
    """Of each partition: a block of the corpus, then all blocks of questions."""

    def asked(block: _Postings, row: dict) -> pa.RecordBatch:
        ends = np.cumsum(np.frombuffer(row["ns"], np.int32)).tolist()
        at, weight, times = np.frombuffer(row["at"], np.int32), np.frombuffer(row["weight"], np.float64).tolist(), np.frombuffer(row["times"], np.int32).tolist()
        number, places = at.tolist(), block.places(np.frombuffer(row["h"], np.int64)).tolist()
        units, out, start = np.zeros(block.padded, np.int64), [], 0
        for query_id, end in zip(row["query_id"], ends):
            units.fill(0)
            hit = []
            for i in range(start, end):
                if (place := places[number[i]]) < 0:
                    continue
                docs, gain = block.gains(place, weight[number[i]], times[i])
                if docs is None:
                    units += gain
                else:
                    units[docs] += gain
                hit.append((i - start, docs, gain))
            width, start = end - start, end
            n = int(np.count_nonzero(units))
            if not n:
                continue
            best, score = block.best(units, max(1, k))
            shown = np.full((len(best), width), ord("0"), np.uint8)
            for i, docs, gain in hit if k else ():
                inside = gain[best] > 0 if docs is None else docs[np.minimum(docs.searchsorted(best), len(docs) - 1)] == best
                shown[inside, i] = ord("1")
            hits = shown.tobytes().decode()
            out += [(query_id, *(c[d] for c in block.place), s / 10**DIGITS, hits[i * width : (i + 1) * width], n) for i, (d, s) in enumerate(zip(best.tolist(), score.tolist()))]
        columns = list(zip(*out)) if out else [[]] * 8
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[f.split(" ")[0] for f in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            for row in b.to_pylist():
                if row["block"] is not None:
                    block = _Postings(row["block"], avgdl)
                elif block is not None:
                    yield asked(block, row["asked"])

    return run


def _scored(corpus: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best texts of every block of the corpus (with k = 0 the one best, without terms), with their place, which
    terms of the question they have (1 or 0 each) and how many texts of the block share one; and the questions'
    terms in that order: (query_id, terms)."""
    slim = corpus.select(*_PLACE, tokens(F.col("text")).alias("t"))
    packed = stage(slim.mapInArrow(_pack, _PACKED), "posting_blocks")
    # Numbers of blocks: a row per some 32768 texts, of which only the count and the sums come here.
    sums = packed.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    hashed = stage(query_terms(queries).mapInArrow(_with_hash, "query_id string, term string, times long, h long"), "query_terms")
    df = packed.select("terms", "starts").mapInArrow(_document_counts, "h long, df long").join(hashed.select("h").distinct().hint("merge"), "h", "left_semi").groupBy("h").agg(F.sum("df").alias("df"))
    weighed = hashed.hint("merge").join(df, "h").select("query_id", F.struct("term", "h", "times", idf(F.lit(sums["n"]), F.col("df")).alias("weight")).alias("t"))
    terms = stage(weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("terms")), "weighed_terms")  # of one question
    slots = max(1, sums["blocks"])
    # A partition per block of the corpus, to which every block of questions goes: a shuffle, as a join could be planned
    # as a broadcast by the size that the questions had before they were repeated.
    numbered = packed.select("blk", (F.row_number().over(Window.orderBy("blk")) - 1).alias("slot"))
    blocks = packed.join(F.broadcast(numbered), "blk").select("slot", F.struct("n", *_PLACE, "dl", "terms", "starts", "docs", "tfs").alias("block"))
    packs = terms.mapInArrow(_pack_questions, _ASKED).select(F.struct("*").alias("asked"))
    spread = packs.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "asked")
    met = blocks.unionByName(spread, allowMissingColumns=True).repartitionById(slots, "slot").sortWithinPartitions(F.col("block").isNull())
    avgdl = sums["total"] / sums["n"] if sums["n"] else 0.0
    return met.select("block", "asked").mapInArrow(_scorer(k, avgdl), _FOUND), terms.select("query_id", F.col("terms.term").alias("terms"))


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("query_id", "term", "times")), pa.array(_signed_hashes(b.column("term").to_pylist()))], names=["query_id", "term", "times", "h"])


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each question by score down, canonical first, then place in the corpus."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *_PLACE)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score, matched_terms): the k best texts of each question.

    ``corpus`` has id, text, canon (0 canonical, 1 not), source and chunk_index (its place); ``queries`` has
    query_id and question. Texts without a common token are no candidates; k below 1 gives nothing.
    """
    found, terms = _scored(corpus, queries, max(1, k))
    best = ranked(found, k).select("query_id", "rank", "id", "score", "hits").join(terms.hint("merge"), "query_id")
    return best.select("query_id", "rank", "id", "score", F.filter("terms", lambda _, i: F.substring("hits", i + 1, F.lit(1)) == "1").alias("matched_terms"))


def matched_counts(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, candidates_matched, best_score): texts that share a term, before any cut, and the best score."""
    scored = _scored(corpus, queries, 0)[0].groupBy("query_id").agg(F.sum("n").alias("n"), F.max("score").alias("top"))
    return queries.select("query_id").join(scored.hint("merge"), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("candidates_matched"), F.coalesce("top", F.lit(0.0)).alias("best_score"))


def diagnostics(found: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, filters: dict[str, object] | None = None) -> DataFrame:
    """One row per question with everything needed to recompute its scores: what ``bm25`` found and out of what.

    Of ``filters`` only ``top_k`` is honoured (it is ``k``); the other names are reported, sorted, and not applied.
    Questions without result have empty lists.
    """
    ignored = sorted(name for name in filters or {} if name != "top_k")
    item = F.struct("rank", "id", "document_id", "score", F.array_join("matched_terms", " ").alias("terms"))
    per = found.join(corpus.select("id", "document_id").hint("merge"), "id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("x"))  # k at most
    listed = {"retrieved_chunk_ids": "id", "document_ids": "document_id", "scores": "score", "ranking": "rank", "matched_terms": "terms"}
    x = queries.join(per.hint("merge"), "query_id", "left").join(matched_counts(corpus, queries).drop("best_score").hint("merge"), "query_id")
    # One row of statistics.
    x = x.join(F.broadcast(corpus_statistics(corpus).select(F.col("n").alias("corpus_size"), F.round("avgdl", DIGITS).alias("average_document_length"))))
    lists = [F.coalesce(F.array_join(F.col(f"x.{c}").cast("array<string>"), ","), F.lit("")).alias(name) for name, c in listed.items()]
    return x.select(
        "query_id", F.col("question").alias("query"), F.array_join(F.array_sort(tokens(F.col("question"))), " ").alias("query_terms"), *lists, F.lit("lexical").alias("retrieval_method"), F.lit(K1).alias("bm25_k1"), F.lit(B).alias("bm25_b"),
        "average_document_length", F.lit(k).alias("top_k"), "candidates_matched", "corpus_size", F.lit(False).alias("sql_filter_applied"), F.lit(",".join(ignored)).alias("filters_ignored"),
    )
