"""White space and small helpers of text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators of ASCII; written out, as a class by property is slow.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those of them that ASCII has: a class of two ranges, where the whole one asks a dozen predicates for each character.
ASCII_WHITE = r"\t-\r\x1c-\x20"
_CHARACTERS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_CHARACTERS))


def is_ascii(c: Column) -> Column:
    """Is every character one byte? Lengths tell, without a pattern."""
    return F.length(c) == F.octet_length(c)


def words(c: Column) -> Column:
    parts = F.when(is_ascii(c), F.split(c, f"[{ASCII_WHITE}]+")).otherwise(F.split(c, f"[{WHITE}]+"))
    return F.filter(parts, lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(c: Column) -> Column:
    """Case folded: texts that differ only in case are equal, also where a letter's cases differ in length, as the sharp s does.

    Lower, upper and lower case again bring all forms of a letter together, but for the final sigma; the dotless i, which has the
    upper case of another letter, stands aside. What stands between two cases also keeps the optimizer from dropping one of them.
    """
    aside = F.upper(F.translate(F.lower(c), "\u0131", "\ue131"))
    return F.translate(F.lower(F.translate(aside, "\ue131", "\u0131")), "\u03c2", "\u03c3")
