"""Queries on retrieval: tokens, BM25, chunking, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import chunk_id, document_id, placeholder_embedding
from corpusloom.functions.text import normal_text
from corpusloom.operators import chunking, fusion, lexical, vectors
from corpusloom.plans import inputs
from corpusloom.runtime import stage, table

K = 5


def q_tokenize_tf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequencies(inputs.corpus(spark, d))


def q_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(lexical.term_frequencies(inputs.corpus(spark, d)))


def q_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_statistics(inputs.corpus(spark, d)).select("n", "total", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return lexical.bm25(inputs.corpus(spark, d), inputs.questions(spark, d), k)


def q_bm25_top5(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", "rank", "id", "score")


def q_bm25_matched_terms(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", "id", F.array_join("matched_terms", " ").alias("matched_terms"))


def q_bm25_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lexical.matched_counts(inputs.corpus(spark, d), inputs.questions(spark, d))


def q_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    n = normal_text(F.col("text"))
    return inputs.documents(spark, d).select("document_id", F.length(n).alias("n"), F.sha2(n, 256).alias("h"))


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk(inputs.documents(spark, d))
    return c.select("id", "document_id", "chunk_index", "character_start", "character_end", F.sha2("text", 256).alias("h"))


def q_chunks_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.documents(spark, d)
    c = chunking.chunk(docs)
    bad = chunking.reconstruction_failures(c, docs).agg(F.count("*").alias("differing"))
    return c.agg(F.count("*").alias("chunks"), F.count_if(F.length("text") > chunking.LIMIT).alias("too_long"), F.count_if(F.length("text") != F.col("character_end") - F.col("character_start")).alias("bad_length")).join(bad)


def q_document_ids(spark: SparkSession, d: str) -> DataFrame:
    return inputs.manifest(spark, d).select("id", "source", document_id(F.col("source")).alias("derived"), (document_id(F.col("source")) == F.col("id")).alias("fits"))


def q_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    derived = chunk_id(F.col("document_id"), F.col("chunk_index"))
    return inputs.corpus(spark, d).where("chunk_index IS NOT NULL").select("id", derived.alias("derived"), (derived == F.col("id")).alias("fits"))


def q_chunk_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return chunking.index_gaps(inputs.corpus(spark, d).where("chunk_index IS NOT NULL"))


def q_chunk_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    return chunking.overlaps(inputs.corpus(spark, d).where("chunk_index IS NOT NULL"))


def q_chunk_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    return chunking.reconstruction_failures(inputs.corpus(spark, d), inputs.documents(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    dims = table(spark, d, "index_identity").select("index_id", "dimension")
    v = table(spark, d, "index_vectors").select("index_id", "vec_id", "vector").where("vector IS NOT NULL").groupBy("index_id", "vec_id").agg(F.min("vector").alias("vector"))
    return v.join(F.broadcast(dims), "index_id").where((F.size("vector") == F.col("dimension")) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def q_vector_top5(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all of its index, by inner product."""
    v = _vectors(spark, d).select(F.col("index_id").alias("space"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("vector").alias("v"))
    return vectors.nearest_of(v.where(F.col("id").cast("long") % 20 == 0), v, K).select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), "score")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lit("e").alias("space"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("embedding").alias("v"))


def q_embedding_top5(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding whose id is divisible by 20 against the whole table, by inner product."""
    e = _embeddings(spark, d)
    return vectors.nearest_of(e.where(F.col("id").cast("long") % 20 == 0), e, K).select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), "score")


def q_placeholder_embedding(spark: SparkSession, d: str) -> DataFrame:
    return inputs.corpus(spark, d).select("id", F.posexplode(placeholder_embedding(F.col("text"))).alias("component", "value"))


def q_index_coverage(spark: SparkSession, d: str) -> DataFrame:
    indexed = table(spark, d, "index_vectors").where("vector IS NOT NULL").select(F.col("chunk_id").alias("id")).distinct()
    c = inputs.corpus(spark, d).select("id")
    side = lambda x, y, name: x.join(y, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return side(c, indexed, "not indexed").unionByName(side(indexed, c, "not in corpus"))


def q_vector_identity(spark: SparkSession, d: str) -> DataFrame:
    """What each index declares against what its vectors have.

    The tables declare the dimension only; it must be the length of every vector. The number of vectors and their
    chunks are held against the corpus: ids must be distinct and every vector's chunk must be there.
    """
    rows = table(spark, d, "index_vectors").where("vector IS NOT NULL").select("index_id", "vec_id", "chunk_id", F.size("vector").alias("n")).distinct()
    there = inputs.corpus(spark, d).select(F.col("id").alias("chunk_id"), F.lit(1).alias("there"))
    seen = rows.join(there, "chunk_id", "left").groupBy("index_id").agg(
        F.when(F.min("n") == F.max("n"), F.min("n")).alias("dimension"), F.count("*").alias("vector_count"), F.count("there").alias("chunk_ids"), F.count_distinct("vec_id").alias("ids")
    )
    declared = table(spark, d, "index_identity").select("index_id", "dimension").join(seen.select("index_id", F.col("ids").alias("vector_count"), F.col("vector_count").alias("chunk_ids")), "index_id", "left")
    return vectors.identity_mismatches(declared, seen.drop("ids"), "index_id").select("index_id", F.array_join("mismatches", ",").alias("mismatches"))


def q_corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return vectors.corpus_fingerprint(inputs.corpus(spark, d), "id", "text")


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = stage(inputs.corpus(spark, d), "corpus")
    queries = stage(inputs.questions(spark, d), "questions")
    lex = stage(lexical.bm25(corpus, queries, K), "lexical")
    return corpus, stage(_semantic(queries, corpus), "semantic"), lex


def _semantic(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    return vectors.semantic(queries, corpus, placeholder_embedding, K)


def q_semantic_top5(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(inputs.questions(spark, d), inputs.corpus(spark, d))


def q_rrf_candidates(spark: SparkSession, d: str) -> DataFrame:
    corpus, sem, lex = _routes(spark, d)
    return fusion.fused_candidates(sem, lex, corpus)


def q_rrf_top5(spark: SparkSession, d: str) -> DataFrame:
    corpus, sem, lex = _routes(spark, d)
    return fusion.reciprocal_rank_fusion(sem, lex, corpus, K).select("query_id", "rank", "id", "score")


def q_route_agreement(spark: SparkSession, d: str) -> DataFrame:
    corpus, sem, lex = _routes(spark, d)
    return fusion.route_agreement(sem, lex, fusion.reciprocal_rank_fusion(sem, lex, corpus, K))


QUERIES = {
    f.__name__: f
    for f in (
        q_tokenize_tf, q_doc_freq, q_corpus_stats, q_bm25_top5, q_bm25_matched_terms, q_bm25_candidates, q_normalize_text, q_chunks, q_chunks_reconstruct, q_document_ids, q_chunk_ids, q_chunk_contiguity, q_chunk_overlap_check,
        q_chunk_reconstruction, q_vector_top5, q_embedding_top5, q_placeholder_embedding, q_index_coverage, q_vector_identity, q_corpus_fingerprint, q_semantic_top5, q_rrf_candidates, q_rrf_top5, q_route_agreement,
    )
}

_C = "WITH " + inputs.CORPUS
_TF = _C + ", tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM corpus), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL)"
BM25 = (
    _TF
    + ", "
    + inputs.QUESTIONS
    + """,
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM corpus),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM questions) GROUP BY ALL),
part AS (SELECT q.query_id, tf.id, q.term, q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS gain FROM qt q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.id = tf.id CROSS JOIN st),
scored AS (SELECT query_id, id, round(sum(gain), 6) AS score, string_agg(term, ' ' ORDER BY term) AS matched_terms FROM part GROUP BY ALL),
lex AS (SELECT s.query_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, canon, source, chunk_index, s.id) AS INT) AS rank, s.id, s.score, s.matched_terms FROM scored s JOIN corpus c ON c.id = s.id QUALIFY rank <= 5)"""
)
_PLACE = "list_transform(range(16), lambda i: CAST(('0x' || substr(sha256({0}), 4 * i + 1, 4)) AS INT) / 65536.0)"
SEMANTIC = f""",
ce AS (SELECT id, {_PLACE.format("text")} AS v FROM corpus), qe AS (SELECT query_id, {_PLACE.format("question")} AS v FROM questions),
sem AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM (SELECT q.query_id, c.id, round(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])), 6) AS score FROM qe q CROSS JOIN ce c) QUALIFY rank <= 5)"""
FUSED = SEMANTIC + """,
cand AS (SELECT query_id, id, max(s) AS semantic_rank, max(l) AS lexical_rank FROM (SELECT query_id, id, rank AS s, NULL AS l FROM sem UNION ALL SELECT query_id, id, NULL, rank FROM lex) GROUP BY ALL),
exact AS (SELECT *, coalesce(1.0 / (60 + semantic_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0) AS x FROM cand),
fusedall AS (SELECT e.query_id, e.id, CAST(e.semantic_rank AS INT) AS semantic_rank, CAST(e.lexical_rank AS INT) AS lexical_rank, round(x, 6) AS score,
  CAST(row_number() OVER (PARTITION BY e.query_id ORDER BY x DESC, c.canon, c.source, c.chunk_index, coalesce(semantic_rank, 1073741824 + lexical_rank), e.id) AS INT) AS rank FROM exact e LEFT JOIN corpus c ON c.id = e.id)"""
_SP = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_GAP = "\\n[ \\t]*\\n[ \\t\\n]*"
# Paragraphs with their offsets, and pieces of those by recursion: as many steps as the longest has pieces.
_CHUNKED = f"""WITH RECURSIVE
par AS (SELECT document_id, regexp_split_to_array(text, '{_GAP}') AS p, regexp_extract_all(text, '{_GAP}') AS g FROM documents WHERE text IS NOT NULL),
one AS (SELECT document_id, i, p[i] AS t, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:i-1], lambda x: length(x))), 0) AS pos FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM par)),
bare AS (SELECT document_id, CAST(pos + length(t) - length(regexp_replace(t, '^{_SP}+', '')) AS BIGINT) AS pos, regexp_replace(regexp_replace(t, '^{_SP}+', ''), '{_SP}+$', '') AS rest FROM one),
cut AS (
  SELECT document_id, pos, rest FROM bare WHERE rest <> ''
  UNION ALL
  SELECT document_id, pos + length(rest) - length(tail), tail
  FROM (SELECT *, regexp_replace(substring(rest, CASE WHEN space > 0 THEN space ELSE {chunking.LIMIT} END + 1), '^{_SP}+', '') AS tail
    FROM (SELECT *, length(regexp_extract(left(rest, {chunking.LIMIT}), '^(.*) ', 1, 's')) AS space FROM cut WHERE length(rest) > {chunking.LIMIT}))
  WHERE tail <> ''),
piece AS (SELECT document_id, pos, CASE WHEN length(rest) <= {chunking.LIMIT} THEN rest WHEN space > 0 THEN left(rest, space) ELSE left(rest, {chunking.LIMIT}) END AS text FROM (SELECT *, length(regexp_extract(left(rest, {chunking.LIMIT}), '^(.*) ', 1, 's')) AS space FROM cut)),
chunked AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS INT) AS chunk_index, CAST(pos AS INT) AS character_start, CAST(pos + length(text) AS INT) AS character_end, text FROM piece)"""
_NEAR = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM ({0}) QUALIFY rank <= 5"
_IN_FINITE = "len(list_filter(v.vector, lambda y: y IS NOT NULL AND isfinite(y))) = dimension AND len(v.vector) = dimension"

ORACLE = {
    "q_tokenize_tf": _TF + " SELECT id, term, tf FROM tf",
    "q_doc_freq": _TF + " SELECT term, count(*) AS df FROM tf GROUP BY term",
    "q_corpus_stats": _C + " SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS total, round(avg(len(t)), 6) AS avgdl FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM corpus)",
    "q_bm25_top5": BM25 + " SELECT query_id, rank, id, score FROM lex",
    "q_bm25_matched_terms": BM25 + " SELECT query_id, id, matched_terms FROM lex",
    "q_bm25_candidates": BM25 + " SELECT q.query_id, count(s.id) AS candidates_matched, coalesce(max(s.score), 0) AS best_score FROM questions q LEFT JOIN scored s ON s.query_id = q.query_id GROUP BY q.query_id",
    "q_document_ids": f"WITH {inputs.MANIFEST} SELECT id, source, left(sha256(source), 12) AS derived, left(sha256(source), 12) = id AS fits FROM man",
    "q_chunk_ids": _C + " SELECT id, left(sha256(document_id || ':' || chunk_index), 16) AS derived, left(sha256(document_id || ':' || chunk_index), 16) = id AS fits FROM corpus WHERE chunk_index IS NOT NULL",
    "q_chunk_contiguity": _C + " SELECT document_id, id, chunk_index, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) - 1 AS place FROM corpus WHERE chunk_index IS NOT NULL) WHERE place <> chunk_index",
    "q_chunk_overlap_check": _C + " SELECT document_id, id, character_end, next_start FROM (SELECT *, lead(character_start) OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS next_start FROM corpus WHERE chunk_index IS NOT NULL) WHERE character_end > next_start",
    "q_chunk_reconstruction": _C + """ SELECT c.document_id, c.id, CASE WHEN d.text IS NULL THEN 'no document' WHEN c.character_start IS NULL OR c.character_end IS NULL THEN 'incomplete' ELSE 'differs' END AS reason
FROM corpus c LEFT JOIN (SELECT document_id, text FROM documents WHERE text IS NOT NULL) d USING (document_id) WHERE NOT coalesce(CASE WHEN c.character_end <= c.character_start THEN '' ELSE substring(d.text, c.character_start + 1, c.character_end - c.character_start) END = c.text, false)""",
    "q_vector_top5": f"WITH v AS (SELECT v.index_id, vec_id, CAST(vector AS DOUBLE[]) AS x FROM (SELECT index_id, vec_id, min(vector) AS vector FROM index_vectors WHERE vector IS NOT NULL GROUP BY ALL) v JOIN index_identity i ON i.index_id = v.index_id WHERE {_IN_FINITE}) "
    + _NEAR.format("SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.x, b.x), 6) AS score FROM v a JOIN v b ON a.index_id = b.index_id WHERE a.vec_id % 20 = 0"),
    "q_embedding_top5": _NEAR.format("SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0"),
    "q_placeholder_embedding": _C + f", e AS (SELECT id, {_PLACE.format('text')} AS v FROM corpus) SELECT id, CAST(unnest(range(16)) AS INT) AS component, CAST(unnest(v) AS DOUBLE) AS value FROM e",
    "q_index_coverage": _C + """, ix AS (SELECT DISTINCT chunk_id AS id FROM index_vectors WHERE vector IS NOT NULL)
SELECT 'not indexed' AS kind, count(*) AS n FROM corpus WHERE id NOT IN (SELECT id FROM ix WHERE id IS NOT NULL) UNION ALL SELECT 'not in corpus', count(*) FROM ix WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.id = ix.id)""",
    "q_vector_identity": _C + """,
vr AS (SELECT DISTINCT index_id, vec_id, chunk_id, CAST(len(vector) AS INT) AS n FROM index_vectors WHERE vector IS NOT NULL),
seen AS (SELECT index_id, CASE WHEN min(n) = max(n) THEN min(n) END AS dimension, count(*) AS vectors, count(c.id) AS chunks, count(DISTINCT vec_id) AS ids FROM vr LEFT JOIN corpus c ON c.id = vr.chunk_id GROUP BY 1)
SELECT coalesce(i.index_id, s.index_id) AS index_id, concat_ws(',', CASE WHEN i.dimension IS DISTINCT FROM s.dimension THEN 'dimension' END,
  CASE WHEN CASE WHEN i.index_id IS NOT NULL THEN s.ids END IS DISTINCT FROM s.vectors THEN 'vector_count' END, CASE WHEN CASE WHEN i.index_id IS NOT NULL THEN s.vectors END IS DISTINCT FROM s.chunks THEN 'chunk_ids' END) AS mismatches
FROM index_identity i FULL JOIN seen s ON i.index_id = s.index_id""",
    "q_chunks": _CHUNKED + " SELECT left(sha256(document_id || ':' || chunk_index), 16) AS id, document_id, chunk_index, character_start, character_end, sha256(text) AS h FROM chunked",
    "q_chunks_reconstruct": _CHUNKED + f""" SELECT count(*) AS chunks, count(*) FILTER (length(c.text) > {chunking.LIMIT}) AS too_long, count(*) FILTER (length(c.text) <> character_end - character_start) AS bad_length,
count(*) FILTER (c.text IS DISTINCT FROM substring(d.text, character_start + 1, character_end - character_start)) AS differing FROM chunked c JOIN documents d USING (document_id)""",
    "q_normalize_text": r"""SELECT document_id, length(n) AS n, sha256(n) AS h FROM (
SELECT document_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^' || sp || '+', ''), sp || '+$', '') AS n
FROM documents, (SELECT '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]' AS sp) WHERE text IS NOT NULL)""",
    "q_corpus_fingerprint": _C + """,
leaf AS (SELECT sha256(sha256(id) || sha256(text)) AS h, count(*) AS n FROM corpus GROUP BY 1), size AS (SELECT greatest(1, CAST(ceil(count(*) / 1024.0) AS BIGINT)) AS nodes FROM leaf),
node AS (SELECT CAST('0x' || left(h, 8) AS BIGINT) % nodes AS node, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS h FROM leaf, size GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, ',' ORDER BY node)) AS fingerprint FROM node""",
    "q_semantic_top5": BM25 + SEMANTIC + " SELECT query_id, rank, id, score FROM sem",
    "q_rrf_candidates": BM25 + FUSED + " SELECT query_id, id, semantic_rank, lexical_rank, score, rank FROM fusedall",
    "q_rrf_top5": BM25 + FUSED + " SELECT query_id, rank, id, score FROM fusedall WHERE rank <= 5",
    "q_route_agreement": BM25 + FUSED + """, s AS (SELECT query_id, list(id) AS s FROM sem GROUP BY 1), l AS (SELECT query_id, list(id) AS l FROM lex GROUP BY 1), f AS (SELECT query_id, list(id) AS f FROM fusedall WHERE rank <= 5 GROUP BY 1),
a AS (SELECT coalesce(s, []) AS s, coalesce(l, []) AS l, coalesce(f, []) AS f FROM s FULL JOIN l USING (query_id) FULL JOIN f USING (query_id))
SELECT count(*) AS questions, round(avg(len(list_distinct(s || l))), 2) AS mean_union, round(avg(len(list_intersect(s, l))), 2) AS mean_overlap, count(*) FILTER (len(list_intersect(s, l)) > 0) AS with_overlap, round(avg(len(list_intersect(f, s))), 2) AS fused_from_semantic, round(avg(len(list_intersect(f, l))), 2) AS fused_from_lexical FROM a""",
}
