"""Documents from files, and the JSON containers the pipeline exchanges.

Files are read with Spark's binary reader, so listing, sizes and retries are Spark's. Python parses only what
has no SQL form (DOCX).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import document_id

# File kinds, manifest version and the name space of DOCX paragraphs.
KINDS = ("docx", "md", "txt")
VERSION = "1.0"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MANIFEST_SCHEMA = "manifest_version string, documents array<struct<id:string,source:string,hash:string,canonical:boolean>>, _corrupt_record string"
CHUNKS_SCHEMA = "schema_version string, chunks array<struct<id:string,document_id:string,text:string,chunk_index:int,character_start:int,character_end:int>>, _corrupt_record string"
FACTS_SCHEMA = "schema_version string, facts array<struct<id:string,source:string,document_id:string,document_source:string,section:string,fact:string,source_text:string>>, _corrupt_record string"
PAIRS_SCHEMA = "schema_version string, qa_pairs array<struct<id:string,source:string,fact_id:string,supporting_fact_ids:array<string>,fact_relation:string,question:string,question_category:string,failure_category:string,expected_answer:string,answerable:boolean>>, _corrupt_record string"
TRACE_SCHEMA = "schema_version string, evidence_trace array<struct<id:string,question:string,expected_answer:string,expected_source:string,expected_chunk:array<string>,expected_retrieval_route:string,expected_reasoning_type:string,expected_metrics:array<string>,expected_outcome:string>>, _corrupt_record string"


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)"


def _relative(root: str) -> Column:
    """The path below ``root``, whether or not the root is given with the scheme and host that paths carry."""
    import re

    plain = F.regexp_replace(F.regexp_replace("path", _SCHEME, ""), "^/+", "/")
    below = re.sub("^/+", "/", re.sub(_SCHEME, "", root)).rstrip("/")
    return F.substring(plain, len(below) + 2, 1 << 30)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(source, kind, content, hash): the document files under ``root`` with their root-relative path.

    Hidden parts of a path (starting with a dot) and ``__pycache__`` are skipped; kinds are compared in
    lower case.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_relative(root).alias("source"), "content")
    kind = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1))
    hidden = F.col("source").rlike(r"(^|/)(\.|__pycache__(/|$))")
    return rows.withColumn("kind", kind).where(F.col("kind").isin(*KINDS) & ~hidden).select("source", "kind", "content", F.sha2("content", 256).alias("hash"))


def manifest_of(found: DataFrame, canonical: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, source, hash, canonical) of files; ``canonical`` names the sources that are."""
    return found.select(document_id(F.col("source")).alias("id"), "source", "hash", F.col("source").isin(*canonical).alias("canonical") if canonical else F.lit(False).alias("canonical"))


def refused_sources(entries: DataFrame, found: DataFrame) -> DataFrame:
    """(source, reason): manifest entries that may not or cannot be read."""
    s = F.col("source")
    reason = (
        F.when(s.isNull() | (s == ""), "no path").when(s.startswith("/") | s.rlike(r"^[A-Za-z]:"), "absolute path").when(s.rlike(r"(^|/)\.\.(/|$)"), "outside the root")
        .when(~F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)).isin(*KINDS), "unsupported kind").when(F.col("there").isNull(), "missing file")
    )
    x = entries.select("source").join(found.select("source", F.lit(1).alias("there")), "source", "left")
    return x.select("source", reason.alias("reason")).where("reason IS NOT NULL")


def docx_paragraphs(content: bytes) -> list[str]:
    """Texts of a DOCX's paragraphs in document order; breaks, tabs and headers do not count."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as f:
        root = ElementTree.parse(f).getroot()
    return ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]


def texts(found: DataFrame) -> DataFrame:
    """(source, text, error): the text of every file; DOCX paragraphs are joined by blank lines, the other
    kinds must be valid UTF-8 and keep their line ends. A file that cannot be read has null text and a reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for source, kind, content in zip(x["source"], x["kind"], x["content"]):
                try:
                    text = "\n\n".join(docx_paragraphs(content)) if kind == "docx" else bytes(content).decode("utf-8")
                    rows.append((source, text, None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError) as e:
                    rows.append((source, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["source", "text", "error"])

    return found.select("source", "kind", "content").mapInPandas(run, "source string, text string, error string")


def container(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """The elements of a container's array, in order (``position``); one that cannot be parsed is an error."""
    x = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    if x.where(F.col("_corrupt_record").isNotNull() | F.col(rows).isNull()).take(1):
        raise ValueError(f"{path} is not a container of {rows}")
    return x.select(F.posexplode(rows).alias("position", "x")).select("position", "x.*")


def write_container(rows: DataFrame, path: str, version_field: str, name: str, order: list[str]) -> None:
    """One JSON document, indented by two, keys as the columns stand, rows in ``order``; byte-stable.

    It streams through the driver row by row: such a file is one file by definition.
    """
    import json

    with open(path, "w", encoding="utf-8") as f:
        head = json.dumps({version_field: VERSION}, ensure_ascii=False)[1:-1]
        f.write("{\n  " + head + ",\n  " + json.dumps(name) + ": [")
        first = True
        for row in rows.orderBy(*order).toLocalIterator():
            body = json.dumps(row.asDict(recursive=True), indent=2, ensure_ascii=False).replace("\n", "\n    ")
            f.write(("" if first else ",") + "\n    " + body)
            first = False
        f.write(("" if first else "\n  ") + "]\n}\n")


def append_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines, added to what the folder holds, never rewriting it."""
    records.write.mode("append").json(path)


def save_index(vectors: DataFrame, identity: DataFrame, path: str) -> None:
    """An index: its vectors as Parquet and its one-row identity as JSON beside them."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    identity.coalesce(1).write.mode("overwrite").json(f"{path}/identity")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, identity, problems): problems are the ways in which vectors and identity disagree."""
    vectors, identity = spark.read.parquet(f"{path}/vectors"), spark.read.json(f"{path}/identity")
    seen = vectors.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"))
    checks = F.array_compact(F.array(F.when(F.col("n") != F.col("vector_count"), "vector_count"), F.when(F.col("ids") != F.col("n"), "chunk_ids"), F.when((F.col("low") != F.col("dimension")) | (F.col("high") != F.col("dimension")), "dimension")))
    return vectors, identity, identity.select("dimension", "vector_count").join(seen).select(F.explode(checks).alias("problem"))


def resolve_index(spark: SparkSession, path: str, expected: DataFrame, rebuild) -> tuple[DataFrame, str]:
    """The index at ``path`` if it is what ``expected`` (a one-row identity) says, else a rebuilt one.

    Returns it with 'loaded', 'rebuilt absent' or 'rebuilt stale'. ``rebuild()`` gives new vectors; it is
    only called when needed.
    """
    from corpusloom.operators.vectors import identity_mismatches

    try:
        vectors, identity, problems = load_index(spark, path)
        one = lambda x: x.withColumn("k", F.lit(1))
        stale = identity_mismatches(one(identity), one(expected), "k").where(F.size("mismatches") > 0).take(1) or problems.take(1)
        if not stale:
            return vectors, "loaded"
        state = "rebuilt stale"
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        state = "rebuilt absent"
    save_index(rebuild(), expected, path)
    return spark.read.parquet(f"{path}/vectors"), state
