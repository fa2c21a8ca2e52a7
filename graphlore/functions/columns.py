"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space as a regular-expression class; anything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as wanted in ``body``.

    A lambda variable is bound, whereas a column repeated inside a
    higher-order function may be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda w: w != F.lit(""))


def null_safe(left: Column, right: Column) -> Column:
    """Equality under which two nulls are equal."""
    return left.eqNullSafe(right)


#: White space that is trimmed from the ends of a text: ASCII, and what Unicode adds; one class for every engine's patterns.
WHITE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The same as characters.
_WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def strip(text: Column) -> Column:
    """A text without white space of any kind at its ends; only the ends are looked at, where a pattern would search all of it."""
    return F.btrim(text, F.lit(_WHITE))
