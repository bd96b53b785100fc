"""Patterns of the cleaning step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a message must not contain, by name. White space includes U+001C to U+001F, as in Python.
CLEANING = {
    "http": r"https?://[^\s\x1c-\x1f]+",
    "www": r"www\.[^\s\x1c-\x1f]+",
    "email": r"\b[^\s\x1c-\x1f]+@[^\s\x1c-\x1f]+\.[^\s\x1c-\x1f]+\b",
    "phone": r"\b\d{1,4}[-.\s\x1c-\x1f]?\d{1,4}[-.\s\x1c-\x1f]?\d{3,4}\b",
    "mention": r"@\w+",
    "community": r"u/\w+",
    "ip": r"\b\d{1,3}(\.\d{1,3}){3}\b",
}


def matches(c: Column, name: str) -> Column:
    """Whether the Unicode-aware, case-insensitive pattern occurs; null texts match nothing."""
    return F.coalesce(c.rlike(f"(?iU){CLEANING[name]}"), F.lit(False))


def sensitive(c: Column) -> Column:
    """Whether any of the patterns occurs, in one pass."""
    return F.coalesce(c.rlike("(?iU)" + "|".join(f"(?:{p})" for p in CLEANING.values())), F.lit(False))
