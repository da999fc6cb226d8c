"""Text: accent folding, case folding for matching, tolerant casts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and these letters. Compatibility forms stay."""
    pairs = {}
    for cp in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(cp))
        base = [c for c in parts if unicodedata.category(c)[0] != "M"]
        if len(parts) > 1 and len(base) == 1:
            pairs[chr(cp)] = base[0]
    return "".join(pairs), "".join(pairs.values())


def strip_accents(text: Column) -> Column:
    """Letters without their marks; loose marks go. Stays in the JVM."""
    return F.regexp_replace(F.translate(text, *_folds()), r"\p{M}", "")


def folded_upper(text: Column) -> Column:
    """Without accents, in upper case; a sharp s stays one letter."""
    return F.upper(F.translate(strip_accents(text), "ß", "ẞ"))


def matches(text: Column, pattern: Column | str) -> Column:
    """Whether the pattern occurs in the text, whatever the case, beyond ASCII too."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_like(text, F.concat(F.lit("(?iu)"), pattern))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def number(text: Column, kind: str = "double") -> Column:
    """A number, or null: no separators between digits, no type suffixes."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), clean.try_cast(kind))
