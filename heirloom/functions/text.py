"""Column helpers for text. Lengths are code points unless a name says bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in several places of one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends. Linear, unlike an anchored regex."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == F.lit("")


def not_blank(c: Column) -> Column:
    return strip(c) != F.lit("")


def first_line(c: Column) -> Column:
    return strip(F.substring_index(c, "\n", 1))


def lines(c: Column) -> Column:
    """Split at ``\\n`` or ``\\r\\n``; a final line break opens no further line."""
    parts = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n")
    return let(
        parts,
        lambda p: F.when(
            F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)
        ).otherwise(p),
    )


def word_count(c: Column) -> Column:
    return let(
        strip(c),
        lambda s: F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+"))),
    )


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def starts_with_any(c: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    """True when ``c`` starts with one of ``prefixes``; false for no prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def strict_json(text: Column) -> Column:
    """The value of a JSON text, NULL unless the text is one value and nothing else.

    A parser stops at the end of the first value. Inside an object no text after the
    value passes but one that closes the object early, and inside an array that fails.
    """
    held = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(held.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))
