"""Texts against many patterns: an equality on three-letter pieces proposes pairs, the regular expression decides.

Every pattern from which it can be told gets a few pieces, of which each match must hold one; it is tried only on texts that
hold one. The others are tried on all texts. Letters are compared as the expressions do it, whatever their case.

Defined cases: a null text, pattern or exclusion pairs nothing, as in SQL; an empty pattern fits every text;
repeated rows give a row for each pair. A malformed expression fails the query when it is tried.
"""

from __future__ import annotations

import re
import warnings
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.text import matches

PIECE = 3
#: The piece of patterns that are tried on all texts.
ANY = ""
#: Expressions beyond this alphabet may mean another thing in the JVM than in Python's parser: they are tried on all texts.
_PLAIN = re.compile(r"(?:[A-Za-z0-9 ñÑ.*+?|()\[\]^$%/,:;_'\"-]|\\[.dDsSwWb\\+*?()\[\]|^$])*")
#: Longer lists of patterns are left to Spark's own choice of a join.
MOST_BROADCAST = 100_000


def pieces(pattern: str | None) -> list[str] | None:
    """Of every match of the pattern, in lower case, at least one of these is a part. [ANY] where that can't be told."""
    if pattern is None:
        return None
    if not _PLAIN.fullmatch(pattern) or "(?" in pattern or "[[" in pattern or re.search(r"\[[^\]]*\[", pattern):
        return [ANY]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = _needed(_parser.parse(pattern))
    except (re.error, RecursionError):
        return [ANY]
    return sorted(found) if found else [ANY]


def _needed(parts) -> set[str] | None:
    """The smallest of the sets that the parts of a sequence offer."""
    offers: list[set[str]] = []
    letters = ""
    for kind, value in [*parts, (None, None)]:
        name = str(kind)
        if name == "LITERAL" and chr(value).isascii():
            letters += chr(value).lower()
            continue
        if len(letters) >= PIECE:
            offers.append({letters[:PIECE]})
        letters = ""
        own = None
        if name == "SUBPATTERN":
            own = _needed(value[3])
        elif name == "BRANCH":
            each = [_needed(p) for p in value[1]]
            own = set().union(*each) if all(each) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            own = _needed(value[2])
        if own:
            offers.append(own)
    return min(offers, key=lambda s: (len(s), sorted(s))) if offers else None


def folded(text: Column) -> Column:
    """In lower case, with all letters that expressions take for an ASCII letter as that letter."""
    return F.lower(F.upper(F.translate(text, "İKſı", "iksi")))


def regex_join(texts: DataFrame, patterns: DataFrame, text: str, include: str, exclude: str, keys: list[str] | None = None) -> DataFrame:
    """Pairs of a text and a pattern whose `include` occurs in it and whose `exclude` doesn't, with all columns of both.

    Columns of both sides must differ, keys aside; with keys, only texts and patterns of equal keys are paired."""
    keys = keys or []
    taken = {*texts.columns, *patterns.columns}
    piece, own, all_ = (next(n for n in (f"{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("piece", "own", "all"))
    lists = patterns.withColumn(all_, F.udf(pieces, "array<string>")(include))  # a row for each pattern
    listed = lists.withColumn(piece, F.explode_outer(all_))  # "outer": no filter that Spark would evaluate beneath a distinct; null pieces meet nothing
    if patterns.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        listed = F.broadcast(listed)
    low = folded(F.col(text))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (PIECE - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(PIECE))))
    rows = texts.filter(F.col(text).isNotNull()).withColumn(own, grams)
    rows = rows.withColumn(piece, F.explode_outer(F.concat(F.array(F.lit(ANY)), F.filter(own, lambda g: F.length(g) == PIECE))))
    # a text may hold several pieces of a pattern: the first of the pattern's list stands for them
    first = F.array_contains(all_, ANY) | (F.get(F.array_intersect(all_, own), F.lit(0)) == F.col(piece))
    fits = matches(F.col(text), F.col(include)) & ~matches(F.col(text), F.col(exclude))
    return rows.join(listed, [*keys, piece]).filter(first & fits).drop(piece, own, all_)
