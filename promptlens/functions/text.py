"""Text expressions with the null and Unicode rules of a text audit.

All are JVM expressions. White space means Unicode white space unless a name says otherwise, lengths
count code points, and a null text gives null; `flag` turns that null into false.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}"


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count(c: Column | str, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.regexp_count(text(c), F.lit(pattern))


def count_literal(c: Column | str, piece: str) -> Column:
    """How often a one-character piece occurs."""
    return F.length(text(c)) - F.length(F.replace(text(c), F.lit(piece), F.lit("")))


def flag(condition: Column) -> Column:
    """A condition where null means false."""
    return F.coalesce(condition, F.lit(False))


def matches(c: Column | str, pattern: str) -> Column:
    return text(c).rlike(pattern)


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(text(c), f"^{WHITE}+|{WHITE}+$", "")


def squished(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), f"{WHITE}+", " "))


def normalized(c: Column | str) -> Column:
    """Lower case and squished: the form for comparing texts."""
    return squished(F.lower(text(c)))


def word_count(c: Column | str) -> Column:
    return count(c, rf"[^{WHITE}]+")


def blank(c: Column | str) -> Column:
    """Nothing but white space; null stays null."""
    return trimmed(c) == ""


def unbalanced(c: Column | str, opening: str, closing: str) -> Column:
    return count_literal(c, opening) != count_literal(c, closing)


def odd_quotes(c: Column | str) -> Column:
    return count_literal(c, '"') % 2 != 0


def visible(c: Column | str) -> Column:
    """Line breaks and tabs spelled out."""
    out = text(c)
    for raw, shown in (("\r", r"\r"), ("\n", r"\n"), ("\t", r"\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def positions(c: Column | str, character: str) -> Column:
    """1-based places of a character, joined by " | "; "" without any, null for null.

    The lengths of the pieces between the characters give the places in one pass.
    """
    pieces = F.split(text(c), re.escape(character), -1)
    heads = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ends = F.aggregate(heads, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)) + F.length(x) + 1)))
    return F.when(text(c).isNotNull(), F.array_join(ends.cast("array<string>"), " | "))


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def one_of(c: Column | str, values: Iterable) -> Column:
    """Membership where null is in no set."""
    return flag(text(c).isin(list(values)))


def first_sentence(c: Column | str) -> Column:
    """Up to the first of .!? before white space or the end; the whole text if there is none."""
    return F.coalesce(F.regexp_substr(text(c), F.lit(rf"(?s)^.*?[.!?](?={WHITE}|\z)")), text(c))


def literal(piece: str) -> str:
    """A pattern for a piece as it stands."""
    return re.sub(r"([^\w\s])", r"\\\1", piece, flags=re.ASCII) if piece.isascii() else "".join("\\" + x if x in r"\.[]{}()*+-?^$|&~#" else x for x in piece)


def alias_pattern(aliases: Iterable[str]) -> str:
    """A pattern that finds any alias as a whole expression, the longest first; none at all without aliases.

    Letters, digits and underscores may not touch either side.
    """
    known = sorted({a for a in aliases if a}, key=lambda a: (-len(a), a))
    if not known:
        return "(?!)"
    return r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(map(literal, known)) + r")(?![\p{L}\p{N}_])"
