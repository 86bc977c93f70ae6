"""References to records that do not exist, resolved against runs of parent keys.

Parent keys are mapped to integers (``key_space``), sorted inside fixed-width buckets and compressed into
contiguous runs. A reference key is as-of matched to the run that starts at or before it: a key past the
run's end (or before the first run) is missing. A run also carries the period in which *all* its members
exist; references made inside that period are settled by the run alone, and only the others are compared
with the life spans of their own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one bucket are consecutive integers, so a bucket never holds more than this many distinct keys.
BUCKET_WIDTH = 4096
_FOREVER = "9999-12-31 00:00:00"


def normal_key(key: Column) -> Column:
    """The key without surrounding spaces, tabs and line ends, lower-cased."""
    return F.lower(F.regexp_replace(key, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def key_space(key: Column) -> tuple[Column, Column]:
    """(space, value): a one-to-one image of a normal key in which consecutive keys have consecutive values.

    Hexadecimal keys count in base 16 by their last 15 digits, other keys in base 10 by their trailing
    digits (15 at most); whatever stands before, and the number of digits, is the space.
    """
    hexadecimal = key.rlike(r"^[0-9a-f]{2,}$")
    tail = F.when(hexadecimal, F.right(key, F.lit(15))).otherwise(F.regexp_extract(key, r"([0-9]{1,15})$", 1))
    head = F.left(key, F.length(key) - F.length(tail))
    space = F.concat(F.when(hexadecimal, F.lit("x")).otherwise(F.lit("d")), F.length(tail).cast("string"), F.lit(":"), head)
    value = F.when(hexadecimal, F.conv(tail, 16, 10).cast("long")).when(tail != "", tail.cast("long")).otherwise(F.lit(0).cast("long"))
    return space, value


def parent_spans(parents: DataFrame, target: str, key: str, start: str, end: str) -> DataFrame:
    """Distinct life spans (target, space, value, born, gone) of the parent keys; ``gone`` may be null.

    Rows whose key or start is null never make a key exist and are left out.
    """
    k = normal_key(F.col(key))
    space, value = key_space(F.col("k"))
    return (
        parents.select(k.alias("k"), F.col(start).alias("born"), F.col(end).alias("gone"))
        .where(F.col("k").isNotNull() & (F.col("k") != "") & F.col("born").isNotNull())
        .select(F.lit(target).alias("target"), space.alias("space"), value.alias("value"), "born", "gone")
        .distinct()
    )


def _bucket() -> Column:
    return F.floor(F.col("value") / F.lit(BUCKET_WIDTH)).cast("long")


def key_runs(spans: DataFrame) -> DataFrame:
    """Contiguous runs of parent keys: (target, space, bucket, run_start, run_end, from_, to_).

    From ``from_`` on and before ``to_`` every key of the run exists; a key with several life spans gives
    its run no such period.
    """
    keys = spans.groupBy("target", "space", "value").agg(F.count("*").alias("n"), F.max("born").alias("born"), F.min(F.coalesce("gone", F.lit(_FOREVER).cast(spans.schema["born"].dataType))).alias("gone"))
    here = Window.partitionBy("target", "space", "bucket").orderBy("value")
    return (
        keys.withColumn("bucket", _bucket())
        .withColumn("opens", F.when(F.col("value") - F.lag("value").over(here) == 1, 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(here))
        .groupBy("target", "space", "bucket", "run")
        .agg(
            F.min("value").alias("run_start"),
            F.max("value").alias("run_end"),
            F.when(F.max("n") == 1, F.max("born")).alias("from_"),
            F.min("gone").alias("to_"),
        )
        .drop("run")
    )


def orphans(references: DataFrame, spans: DataFrame) -> DataFrame:
    """The references that no parent satisfies.

    ``references`` has ref_table, record_id, ref_field, target, key (raw) and made_at. Null and blank keys
    are no references. A reference is satisfied when its target has a row of that key with
    ``born <= made_at`` and ``gone`` null or later than ``made_at``; one without ``made_at`` is satisfied by
    nothing. Repeated references count once. Columns: ref_table, record_id, ref_field, ref_key, made_at.
    """
    k = F.col("ref_key")
    space, value = key_space(k)
    refs = (
        references.select("ref_table", "record_id", "ref_field", "target", normal_key(F.col("key")).alias("ref_key"), "made_at")
        .where(k.isNotNull() & (k != ""))
        .distinct()
        .withColumns({"space": space, "value": value})
    )
    runs = key_runs(spans)
    wanted = refs.groupBy("target", "space", "value").agg(F.min("made_at").alias("first"), F.max("made_at").alias("last"), F.count_if(F.col("made_at").isNull()).alias("undated"))
    before = Window.partitionBy("target", "space", "bucket").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    both = runs.select("target", "space", "bucket", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), F.struct("run_end", "from_", "to_").alias("run")).unionByName(
        wanted.select("target", "space", _bucket().alias("bucket"), F.col("value").alias("at"), F.lit(1).alias("is_ref"), "first", "last", "undated"), allowMissingColumns=True
    )
    matched = both.withColumn("run", F.last("run", ignorenulls=True).over(before)).where("is_ref = 1")
    inside = F.col("run").isNotNull() & (F.col("at") <= F.col("run.run_end"))
    settled = (F.col("undated") == 0) & (F.col("first") >= F.col("run.from_")) & (F.col("last") < F.col("run.to_"))
    verdict = matched.select(
        "target", "space", F.col("at").alias("value"), F.when(~F.coalesce(inside, F.lit(False)), "missing").when(F.coalesce(settled, F.lit(False)), "settled").otherwise("open").alias("verdict")
    ).where("verdict <> 'settled'")
    left = refs.join(verdict, ["target", "space", "value"])
    r, s = left.where("verdict = 'open'").alias("r"), spans.alias("s")
    alive = (F.col("s.born") <= F.col("r.made_at")) & (F.col("s.gone").isNull() | (F.col("s.gone") > F.col("r.made_at")))
    late = r.join(s, (F.col("r.target") == F.col("s.target")) & (F.col("r.space") == F.col("s.space")) & (F.col("r.value") == F.col("s.value")) & alive, "left_anti")
    out = ["ref_table", "record_id", "ref_field", "ref_key", "made_at"]
    return left.where("verdict = 'missing'").select(*out).unionByName(late.select(*out))


def references_of(records: DataFrame, table: str, record_id: str, made_at: str, fields: dict[str, str]) -> DataFrame:
    """References of a table in long form; ``fields`` maps a string or array column to its target."""
    kinds = dict(records.dtypes)

    def keys(column: str, target: str) -> Column:
        values = F.col(column) if kinds[column].startswith("array") else F.array(F.col(column))
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(column).alias("ref_field"), F.lit(target).alias("target"), x.alias("key")))

    return records.select(
        F.lit(table).alias("ref_table"), F.col(record_id).alias("record_id"), F.col(made_at).alias("made_at"), F.explode(F.concat(*(keys(c, t) for c, t in fields.items()))).alias("x")
    ).select("ref_table", "record_id", "made_at", "x.*")


def orphan_report(references: DataFrame, found: DataFrame) -> DataFrame:
    """References, distinct records and orphans per table, field and month of ``made_at`` (null: undated)."""
    month = F.date_format("made_at", "yyyy-MM").alias("month")
    k = normal_key(F.col("key"))
    all_refs = references.select("ref_table", "record_id", "ref_field", k.alias("ref_key"), "made_at").where(F.col("ref_key").isNotNull() & (F.col("ref_key") != "")).distinct()
    total = all_refs.groupBy("ref_table", "ref_field", month).agg(F.count("*").alias("n_refs"), F.lit(0).cast("long").alias("n_orphans"))
    bad = found.groupBy("ref_table", "ref_field", month).agg(F.lit(0).cast("long").alias("n_refs"), F.count("*").alias("n_orphans"))
    return total.unionByName(bad).groupBy("ref_table", "ref_field", "month").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_orphans").alias("n_orphans"))
