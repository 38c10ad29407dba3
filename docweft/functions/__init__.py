"""Column functions over texts. Patterns are written so that Java and RE2 read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"
UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
WORD = r"[\p{L}\p{N}_]"


def text_of(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_tokens(col: Column | str) -> Column:
    """Words between white space."""
    return F.regexp_count(text_of(col), F.lit(NOT_SPACE))


def tokens(col: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(text_of(col)), NOT_WORD), lambda x: x != "")


def sentences(col: Column | str) -> Column:
    """Split after . ! or ? and white space."""
    marked = F.regexp_replace(F.trim(text_of(col)), r"([.!?])\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.trim(x)), lambda x: x != "")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def removed(col: Column, pattern: str) -> Column:
    """How many characters match the pattern of one character."""
    return F.length(col) - F.length(F.regexp_replace(col, pattern, ""))


def content_type(col: Column | str) -> Column:
    """table: two lines with a bar; list: most lines are bullets; heading: one line, under 100 characters, six words at most."""
    text = text_of(col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    bars = F.size(F.filter(lines, lambda x: x.contains("|")))
    bullets = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^([•*–-]|\d+[.)]\s)")))
    return (
        F.when(F.size(lines) == 0, "paragraph")
        .when(bars >= 2, "table")
        .when(bullets * 2 > F.size(lines), "list")
        .when((F.size(lines) == 1) & (F.length(F.trim(text)) < 100) & (n_tokens(text) <= 6), "heading")
        .otherwise("paragraph")
    )
