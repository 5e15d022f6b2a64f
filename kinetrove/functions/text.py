"""Token-level expressions for chemical text files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Whitespace-separated words; a blank line has none."""
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def number(text: Column) -> Column:
    """A plain or Fortran float (1.0D-3), NULL when it is neither."""
    return F.regexp_replace(F.trim(text), "[Dd]", "E").try_cast("double")


def word(parts: Column, n: int) -> Column:
    """n-th word from 0, NULL past the end."""
    return F.get(parts, n)


def symbol(text: Column) -> Column:
    """Element symbol with an upper-case first letter; X when there is none."""
    t = F.trim(text)
    cased = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))
    return F.when(t.isNull() | (t == ""), "X").otherwise(cased)


def symbol_of_potential(line: Column) -> Column:
    """Element at the head of a pseudopotential line such as ``*Si_PBE.psp``."""
    return symbol(F.regexp_extract(F.trim(line), r"^\**([A-Za-z]{1,2})", 1))
