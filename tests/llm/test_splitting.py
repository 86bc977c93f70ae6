"""Pieces of oversized items: within the limit, gapless, overlapping, at natural boundaries."""

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.splitting import cut, split_oversized


def check(text, limit, overlap):
    spans = cut(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    for (_, e), (s, _) in zip(spans, spans[1:]):
        assert s == e - overlap
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n,。é", min_size=31, max_size=400), st.integers(0, 12))
def test_pieces_cover_and_fit(text, overlap):
    check(text, 30, overlap)


def test_natural_boundaries_win():
    text = "One sentence here. Another one there.\n\nA second paragraph. It goes on."
    spans = check(text, 45, 0)
    assert spans[0][1] == text.index("A second")


def test_no_boundary_is_cut_hard():
    assert len(check("x" * 100, 30, 10)) == 5


def test_leader_dots_take_time_in_proportion():
    import time

    text = "Chapter " + "." * 400_000 + '"' * 100_000 + " end. Next."
    began = time.perf_counter()
    check(text, 1000, 50)
    assert time.perf_counter() - began < 10


def test_combining_marks_stay_together():
    text = "é" * 50
    assert all(b % 2 == 0 for _, b in cut(text, 31, 0))


def test_frame(spark):
    rows = [("a", "w " * 100, 1, "x"), ("a", "w " * 100, 1, "x"), ("b", None, 1, "x"), ("c", "", 1, "x"), ("d", "y" * 50, 1, "x"), (None, "z" * 60, 1, "x")]
    df = spark.createDataFrame(rows, "id string, text string, at int, piece_text string")
    got = split_oversized(df, "id", "text", 50, 5, newest="at").collect()
    assert {r.item_key for r in got} == {"a", None}
    a = sorted((r for r in got if r.item_key == "a"), key=lambda r: r.piece_index)
    assert [r.piece_text for r in a] == [("w " * 100)[r.piece_start : r.piece_end] for r in a]
    assert split_oversized(df.limit(0), "id", "text", 50, 5).count() == 0
