"""Data-quality checks: every check is a frame (check, key, detail) of violations, empty if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, check: str, key: Column | str, detail: Column | str) -> DataFrame:
    """Rows as violations of one check."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(F.lit(check).alias("check"), as_col(key).cast("string").alias("key"), as_col(detail).cast("string").alias("detail"))


def duplicates(rows: DataFrame, key: str, check: str) -> DataFrame:
    """Keys that stand in more than one row."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return violations(n, check, key, "n")


def missing_fields(rows: DataFrame, key: str, fields: dict[str, str], check: str) -> DataFrame:
    """Rows in which a field is null, blank, or does not match its pattern ('' for any; a '$' at its end is the
    end of the value, not that of its last line)."""
    fields = {c: p[:-1] + r"\z" if p.endswith("$") else p for c, p in fields.items()}
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") | (~F.col(c).cast("string").rlike(p) if p else F.lit(False)), F.lit(c)) for c, p in fields.items())))
    return violations(rows.withColumn("bad", bad).where(F.size("bad") > 0), check, key, F.array_join("bad", ","))


def orphan_keys(rows: DataFrame, key: str, field: str, parents: DataFrame, parent_key: str, check: str) -> DataFrame:
    """Rows whose field (or array element) is no parent's key; null fields are no references."""
    kind = dict(rows.dtypes)[field]
    x = rows.select(F.col(key).alias("k"), (F.explode(field) if kind.startswith("array") else F.col(field)).alias("ref")).where("ref IS NOT NULL")
    return violations(x.join(parents.select(F.col(parent_key).alias("ref")).distinct(), "ref", "left_anti"), check, "k", "ref")


def childless(parents: DataFrame, key: str, children: DataFrame, field: str, check: str) -> DataFrame:
    """Parents that no child names."""
    x = parents.select(key).distinct().join(children.select(F.col(field).alias(key)).distinct(), key, "left_anti")
    return violations(x, check, key, F.lit("none"))


def stale_hashes(manifest: DataFrame, documents: DataFrame, check: str) -> DataFrame:
    """Manifest entries whose hash is not that of their document's text."""
    x = manifest.join(documents.select(F.col("document_id").alias("id"), "text"), "id").where("text IS NOT NULL")
    return violations(x.where(F.sha2("text", 256) != F.col("hash")), check, "id", F.lit("stale"))


def not_verbatim(facts: DataFrame, documents: DataFrame, check: str) -> DataFrame:
    """Facts whose source text does not stand exactly once in their document."""
    x = facts.where("source_text <> ''").join(documents.where("text IS NOT NULL").select("document_id", "text"), "document_id")
    n = F.floor((F.length("text") - F.length(F.replace("text", F.col("source_text"), F.lit("")))) / F.length("source_text"))
    return violations(x.withColumn("n", n).where("n <> 1"), check, "id", "n")


def copied_field(rows: DataFrame, key: str, field: str, others: DataFrame, other_key: str, other_field: str, check: str) -> DataFrame:
    """Rows whose field differs from the field of the row they were copied from (nulls are equal)."""
    x = rows.select(F.col(key).alias("k"), F.col(field).alias("mine")).join(others.select(F.col(other_key).alias("k"), F.col(other_field).alias("theirs")), "k")
    return violations(x.where(~F.col("mine").eqNullSafe(F.col("theirs"))).distinct(), check, "k", F.lit("differs"))


def report(found: list[DataFrame], checks: list[str]) -> DataFrame:
    """(check, status, violations): every check, PASS at none."""
    spark = found[0].sparkSession
    names = spark.createDataFrame([(c,) for c in checks], "check string")
    n = reduce(DataFrame.unionByName, found).groupBy("check").agg(F.count("*").alias("n"))
    return names.join(n, "check", "left").select("check", F.when(F.col("n").isNull(), "PASS").otherwise("FAIL").alias("status"), F.coalesce("n", F.lit(0)).alias("violations"))


def passed(found: DataFrame) -> None:
    """Raise if there is a violation, naming the first few."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("; ".join(f"{r['check']}: {r['key']} ({r['detail']})" for r in rows))
