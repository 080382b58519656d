"""Character classes that mean the same in Java's regex engine as in Unicode-aware ones, and for RE2.

A pattern is written once with placeholders: ``{W}`` word character, ``{S}`` white space, ``{NS}`` other than
white space, ``{B}`` word boundary. ``java`` fills them for Spark, ``re2`` for DuckDB, where a boundary
before the match becomes a captured neighbour (group 1) that the replacement puts back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
S_INNER = r"\s\x1c-\x1f\x85\p{Z}"
S = f"[{S_INNER}]"
NS = f"[^{S_INNER}]"
BOUNDARY = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"


def classes(pattern: str) -> str:
    """The placeholders for a pattern that is written with ``\\s``, ``\\S``, ``\\w`` and ``\\b`` outside of brackets."""
    return pattern.replace(r"\s", "{S}").replace(r"\S", "{NS}").replace(r"\w", "{W}").replace(r"\b", "{B}")


def java(pattern: str, flags: str = "") -> str:
    out = pattern.replace("{W}", W).replace("{NS}", NS).replace("{S}", S).replace("{B}", BOUNDARY)
    return f"(?{flags}){out}" if flags else out


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Inside of a class with every code point that counts as a digit, decimal or not (superscripts, circled, Ethiopic)."""
    extra = [o for o in range(0x20000) if chr(o).isdigit() and unicodedata.category(chr(o)) != "Nd"]
    parts, at = [], 0
    while at < len(extra):
        to = at
        while to + 1 < len(extra) and extra[to + 1] == extra[to] + 1:
            to += 1
        parts.append(rf"\x{{{extra[at]:X}}}" + (rf"-\x{{{extra[to]:X}}}" if to > at else ""))
        at = to + 1
    return r"\p{Nd}" + "".join(parts)


def replace_all(text: Column, pattern: str, by: str = " ", flags: str = "") -> Column:
    return F.regexp_replace(text, F.lit(java(pattern, flags)), F.lit(by))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it (Catalyst would put it in at each place)."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, F.lit(rf"^{S}+|{S}+$"), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space to one space, ends stripped."""
    return strip(F.regexp_replace(text, F.lit(f"{S}+"), F.lit(" ")))
