"""Shared spans against a comparison of all windows, also where every minimizer is a crowd."""

import random

import pytest

from corpusloom.llm import spans

SCHEMA = "record_table string, record_id string, text string, txt int"


def brute(rows, span):
    texts = {}
    for t, i, x in rows:
        if i is not None and x is not None:
            texts.setdefault((t, i), set()).add(x)
    where = {}
    for key, xs in texts.items():
        for x in xs:
            for s in range(len(x) - span + 1):
                where.setdefault(x[s : s + span], set()).add(key)
    out = {}
    for key, xs in texts.items():
        for x in xs:
            covered = set()
            for s in range(len(x) - span + 1):
                if len(where[x[s : s + span]]) > 1:
                    covered.update(range(s, s + span))
            if covered:
                out[key] = max(out.get(key, 0), len(covered))
    return out


def got(spark, rows, span, crowd=None):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    return {(r.record_table, r.record_id): r.covered for r in spans.shared_records(df, span, crowd).collect()}


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdé 日"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common = [text(rng.randrange(100, 400)) for _ in range(6)]
    rows = []
    for i in range(60):
        x = text(rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            c = rng.choice(common)
            a = rng.randrange(len(c))
            x += c[a : a + rng.randrange(60, 300)] + text(rng.randrange(0, 90))
        rows.append((rng.choice("ab"), f"r{i}", x))
    return rows + [("a", "null", None), (None, "n", "x" * 130), ("a", None, "y" * 500), ("a", "short", "z"), ("a", "empty", ""), rows[0], ("b", "copy", rows[5][2] + "tail"), ("b", "same", rows[7][2])]


@pytest.mark.parametrize("crowd", [None, 1])
def test_as_all_windows(spark, crowd):
    rows = corpus(3)
    assert got(spark, rows, 120, crowd) == brute(rows, 120)


@pytest.mark.parametrize("crowd", [None, 1])
def test_a_record_shares_nothing_with_itself(spark, crowd):
    core, other = ("".join(random.Random(n).choice("abcdefgh ") for _ in range(200)) for n in (1, 2))
    rows = [("a", "1", core + "x" * 50), ("a", "1", "y" * 60 + core), ("a", "2", "m" + other), ("a", "2", other + "n"), ("b", "2", "q" + other)]
    rows += [("a", "2", "boilerplate " * 20), ("a", "3", "boilerplate " * 20)] * 3
    assert got(spark, rows, 120, crowd) == brute(rows, 120)
    assert ("a", "1") not in got(spark, rows, 120, crowd)


def test_no_rows(spark):
    assert got(spark, [], 120) == {}


def test_span_of_exactly_the_least_length(spark):
    core = "".join(random.Random(1).choice("abcdefgh") for _ in range(120))
    rows = [("a", "1", "x" * 31 + core + "y" * 50), ("a", "2", "q" * 7 + core + "p" * 90), ("a", "3", "m" * 5 + core[:119] + "n" * 60)]
    assert got(spark, rows, 120) == {("a", "1"): 120, ("a", "2"): 120}
