"""Text expressions: tokens, normal form, verdicts and claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space beyond Java's Unicode \s.
_SPACE = r"(?U)[\s\x1c-\x1f]"
# Characters trimmed from a verdict, and the markers a claim line may start with.
VERDICT_TRIM = " \t\r\n.`*\"'"
CLAIM_MARKERS = ("- ", "* ", "• ", "– ")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, with repetition; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Without white space (in the Unicode sense) at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"{_SPACE}+\\z", ""), f"\\A{_SPACE}+", "")


def normal_text(text: Column) -> Column:
    """One kind of line end, no blanks before line ends, at most one empty line in a row, stripped."""
    unified = F.regexp_replace(text, "\r\n|\r", "\n")
    trimmed = F.regexp_replace(unified, r"(?md)[ \t]+$", "")
    return strip(F.regexp_replace(trimmed, "\n{3,}", "\n\n"))


def verdict(answer: Column, vocabulary: tuple[str, ...]) -> Column:
    """The verdict an answer consists of, or null if it is not exactly one word of the vocabulary."""
    word = F.upper(F.btrim(answer, F.lit(VERDICT_TRIM)))
    return F.when(word.isin(*vocabulary), word)


def claims(answer: Column) -> Column:
    """The claims of an answer: its lines, stripped, without list markers and numbers, blanks dropped."""
    lines = F.transform(F.split(answer, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"), strip)
    for marker in CLAIM_MARKERS:
        lines = _without(lines, "\\Q" + marker + "\\E")
    numbered = F.transform(lines, lambda line: strip(F.regexp_replace(line, r"^[0-9]+[.)]", "")))
    return F.filter(numbered, lambda line: line != "")


def _without(lines: Column, marker: str) -> Column:
    return F.transform(lines, lambda line: strip(F.regexp_replace(line, f"^(?:{marker})+", "")))


def share(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """``part / whole``, 0.0 where nothing is there to divide by, rounded unless ``digits`` is None."""
    value = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return value if digits is None else F.round(value, digits)
