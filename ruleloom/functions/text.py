"""Text functions with the semantics that spans depend on: offsets in code points, white space as in ECMAScript."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript's \s, which is wider than Java's: inside a character class, and as one.
ODD_SPACES = r"\t-\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = ODD_SPACES + " "
WS = f"[{SPACES}]"
NON_WS = f"[^{SPACES}]"


def pattern(p: str) -> str:
    """A pattern of the vocabulary, with [WS] and [NWS] written out."""
    return p.replace("[WS]", WS).replace("[NWS]", NON_WS)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(text: Column | str, p: str) -> Column:
    return F.regexp_like(col(text), F.lit(pattern(p)))


def replace(text: Column | str, p: str, by: str) -> Column:
    return F.regexp_replace(col(text), pattern(p), by)


def extract(text: Column | str, p: str, group: int = 1) -> Column:
    """The group's text, or null where the pattern doesn't match."""
    return F.when(matches(text, p), F.regexp_extract(col(text), pattern(p), group))


def extract_all(text: Column | str, p: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern(p)), F.lit(group))


def search(text: Column | str, p: str) -> Column:
    """The first match's place from 0, or null."""
    return F.nullif(F.regexp_instr(col(text), F.lit(pattern(p))), F.lit(0)) - 1


def trim(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"^{WS}+|{WS}+\z", "")


def collapse(text: Column | str) -> Column:
    """Each run of white space as one space, none at the ends. A plain space between words stays as it is."""
    return F.trim(F.regexp_replace(col(text), f"{WS}{{2,}}|[{ODD_SPACES}]", " "))


def cut(text: Column | str, start: Column | int, end: Column | int) -> Column:
    """The half-open range from 0, clipped to the text."""
    a = F.greatest(F.lit(0), start if isinstance(start, Column) else F.lit(start))
    b = end if isinstance(end, Column) else F.lit(end)
    return F.substring(col(text), a + 1, F.greatest(F.lit(0), b - a))


def is_blank(text: Column | str) -> Column:
    return ~matches(text, "[NWS]")


def sorted_words(text: Column | str, p: str) -> Column:
    """The matches as a multiset: normalised, lower-cased, sorted."""
    return F.array_sort(F.transform(extract_all(text, p), lambda x: F.lower(collapse(x))))
