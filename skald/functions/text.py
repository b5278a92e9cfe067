"""Text rules of the message model: patterns, trimming, lengths and token estimates, all as JVM expressions.

A dot means any character but the line ends of the message model (\\n \\r U+2028 U+2029), matching ignores ASCII case, and only the first match counts.
Lengths count UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of decisions, corrections, entities and changes of topic; white space that trimming removes.
DECISIONS = [
    "we (?:decided|agreed|settled) (?:on|to|that) (.+)",
    "let'?s (?:use|go with) (.+)",
    "i'?ll (?:use|implement) (.+)",
    "the (?:plan|decision) is (.+)",
]
CORRECTIONS = ["actually,? (.+)", "no,? (?:wait|that'?s wrong)", "i mean (.+)", "instead,? (.+)", "not (.+),? (?:but|rather) (.+)", "correction:? (.+)"]
ENTITIES = ["we'?re using (.+?) (?:for|as)", "the (.+?) is (.+)", "set up (.+?) with", "connected to (.+)"]
SHIFTS = ["moving on", "by the way", "on a different note", "switching topics", "also,? (.+)", "new question"]
SPACES = "\\t\\n\\u000b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def java(pattern: str) -> str:
    return "(?i)" + pattern.replace(".+", "[^\\n\\r\\u2028\\u2029]+")


def matches_any(text: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(java(p))
    return F.coalesce(found, F.lit(False))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def units(text: Column) -> Column:
    """UTF-16 length."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def tokens(text: Column) -> Column:
    return F.ceil(units(text) / 4).cast("long")


def captures(text: Column, patterns: list[str]) -> Column:
    """Trimmed first groups of all patterns that match and have one, in the patterns' order; repeats stay."""
    found = [F.when(text.rlike(java(p)), trim(F.regexp_extract(text, java(p), 1))) for p in patterns if "(.+" in p]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def prefix(text: Column, n: int) -> Column:
    """The first n UTF-16 units; a character that would be split is left out."""
    wide = F.encode(text, "UTF-16BE")
    cut_pair = F.hex(F.substring(wide, 2 * n - 1, 1)).between("D8", "DB")
    short = F.decode(F.substring(wide, F.lit(1), F.when(cut_pair, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    return F.when(F.length(text) == units(text), F.substring(text, 1, n)).otherwise(short)
