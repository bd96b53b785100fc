"""Unicode-aware text expressions. All run inside the JVM; none needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's ``str.split`` and ``str.strip`` treat as white space.
WS = r"[\s\x0b\x1c-\x1f\x85   -     　]"
#: Accented Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďēęěğīłńňōőřśşšťūůűźżž"
BASE = "aaaaaaceeeeiiiinoooooouuuuyyaaaccdeeegilnnoorssstuuuzzz"


def strip(c: Column) -> Column:
    """``c`` without Unicode white space at its ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def word_count(c: Column) -> Column:
    """Number of words split at Unicode white space; null counts as one word, an empty text as none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("nan")), WS + "+"), lambda w: w != ""))


def fold(c: Column) -> Column:
    """Lower case without accents, combining marks and invisible format characters."""
    low = F.replace(F.lower(c), F.lit("œ"), F.lit("oe"))
    return F.translate(F.regexp_replace(low, r"[\p{M}\p{Cf}]+", ""), ACCENTED, BASE)


def folded_words(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
