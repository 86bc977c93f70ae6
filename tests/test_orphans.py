"""Orphan references against a comparison with every parent."""

import random
from datetime import datetime, timedelta

from corpusloom.operators import orphans as op

T0 = datetime(2024, 1, 1)
REF = "ref_table string, record_id string, ref_field string, target string, key string, made_at timestamp"
PARENT = "id string, loaded_at timestamp, deleted_at timestamp, target string"


def run(spark, refs, parents):
    spans = op.parent_spans(spark.createDataFrame(parents, PARENT), "p", "id", "loaded_at", "deleted_at")
    got = op.orphans(spark.createDataFrame(refs, REF), spans).collect()
    return {(r.record_id, r.ref_key) for r in got}


def norm(k):
    return k.strip(" \t\r\n").lower()


def brute(refs, parents):
    bad = set()
    for _, rec, _, _, key, at in refs:
        if key is None or not norm(key):
            continue
        ok = any(i is not None and norm(i) == norm(key) and a is not None and at is not None and a <= at and (b is None or b > at) for i, a, b, _ in parents)
        if not ok:
            bad.add((rec, norm(key)))
    return bad


def test_random_tables(spark):
    rng = random.Random(5)
    day = lambda n: T0 + timedelta(days=n)
    keys = [f"f{n:06d}" for n in range(60)] + [f"{rng.getrandbits(64):016x}" for _ in range(30)] + ["odd key", "7", "f1", "x-"]
    parents = [(rng.choice(keys) if rng.random() < 0.9 else rng.choice(keys).upper() + " ", day(rng.randrange(40)), day(rng.randrange(40, 80)) if rng.random() < 0.3 else None, "t") for _ in range(90)]
    parents += parents[:10] + [(None, T0, None, "t"), ("late", None, None, "t")]
    refs = [("t", f"r{i}", "f", "p", rng.choice([*keys, "f999999", "", " ", None, " F000001\n", "late"]), day(rng.randrange(100)) if rng.random() < 0.95 else None) for i in range(300)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_empty_tables(spark):
    refs = [("t", "r", "f", "p", "k1", T0)]
    assert run(spark, refs, []) == {("r", "k1")}
    assert run(spark, [], [("k1", T0, None, "x")]) == set()


def test_key_space_is_one_to_one(spark):
    keys = ["f1", "f01", "f10", "0a", "00a", "a", "ff" * 8, "0" * 16, "abc", "f" * 15, "1" * 20, "x" + "9" * 17, ""]
    space, value = op.key_space(__import__("pyspark").sql.functions.col("k"))
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(space, value)
    assert df.distinct().count() == len(keys)
