"""Near-duplicates: the signature join against all pairs, also where a template crowds every signature."""

import random
import re

import pytest

from corpusloom.llm import components, edits


def brute(rows, t):
    sets = {i: set(re.findall(r"[^\W_]+", x.lower())) for i, x in rows if i is not None and x is not None}
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def found(spark, rows, t=0.7):
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "id string, text string, cls int")
    classes, members = edits.word_classes(df, "k", "id", "text")
    pairs = edits.near_duplicate_classes(classes, t)
    return {(r.id_a, r.id_b) for r in edits.member_pairs(pairs, members).collect()}


def corpus(seed, n, words, names):
    rng = random.Random(seed)
    frame = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = [*rng.sample(frame, words - rng.randrange(3)), *(f"n{rng.randrange(names)}" for _ in range(rng.randrange(1, 6)))]
        rng.shuffle(text)
        rows.append((f"id{i:04d}", " ".join(text)))
    return rows


@pytest.mark.parametrize("words, names", [(14, 60), (3, 8)])
def test_same_pairs_as_brute_force(spark, words, names, monkeypatch):
    monkeypatch.setattr(edits, "CROWD", 3)
    rows = corpus(words, 90, words, names)
    assert found(spark, rows) == brute(rows, 0.7)


def test_a_crowd_of_similar_sets_is_paired_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(edits, "CROWD", 3)
    rows = [(f"s{i:02d}", f"a b c d e f g h i x{i}") for i in range(12)] + [(f"t{i}", f"a b{i}") for i in range(6)] + [(f"u{i}", f"a b c{i}") for i in range(6)]
    assert found(spark, rows, 0.8) == brute(rows, 0.8)


def test_cases(spark):
    rows = [("a", "One two three"), ("b", "one, TWO three!"), ("c", None), ("d", ""), ("e", "..."), (None, "one two three"), ("f", "one two three four"), ("g", "one"), ("g", "one")]
    assert found(spark, rows) == {("a", "b"), ("a", "f"), ("b", "f")}
    assert found(spark, []) == set()


def test_groups(spark):
    rows = [("a", "p q r s t u v"), ("b", "p q r s t u v w"), ("c", "p q r s t u v w x"), ("d", "z y"), ("e", "y z")]
    df = spark.createDataFrame(rows, "id string, text string")
    classes, members = edits.word_classes(df, "k", "id", "text")
    got = {r.id: r for r in edits.near_duplicate_groups(edits.near_duplicate_classes(classes, 0.8), members).collect()}
    assert got["a"].grp == got["c"].grp != got["d"].grp == got["e"].grp
    assert got["d"].copies == 2 and got["b"].links == 2


@pytest.mark.parametrize("order", ["falling", "random"])
def test_components_of_a_long_chain(spark, monkeypatch, order):
    names = [f"n{i:04d}" for i in ([0, *range(999, 0, -1)] if order == "falling" else random.Random(4).sample(range(1000), 1000))]
    rounds = []
    staged = components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: rounds.append(name) or staged(df, name))
    links = spark.createDataFrame([*zip(names, names[1:]), ("x", "y"), ("y", "x"), ("y", "y"), (None, "n0003")], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in [*names, "x", "y", "alone"]], "cls string")
    got = {r.cls: r.grp for r in components.components(links, nodes).collect()}
    assert {got[n] for n in names} == {"n0000"} and got["x"] == got["y"] == "x" and got["alone"] == "alone"
    assert rounds.count("links") <= 15
    assert components.components(links.limit(0), nodes.limit(1)).count() == 1
