"""Normaliser, markers and atomic units.

``[U+HHHH NAME]`` stands for a character beyond ASCII; ``__U_HHHH__`` is its space-free stand-in
during training. Lengths count a marker or stand-in as one. Null texts come out as "".
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import rules
from corpusloom.functions.regexkit import collapse, replace_all
from corpusloom.runtime import valid

_ONE_TO_ONE = {k: v for k, v in rules.PUNCTUATION.items() if len(v) == 1}
_DELETED = "".join(k for k, v in rules.PUNCTUATION.items() if not v)
_TABLE = str.maketrans(rules.PUNCTUATION)


def marker(ch: str) -> str:
    """The marker of one character."""
    return f"[U+{ord(ch):04X} {unicodedata.name(ch, 'UNKNOWN')}]"


@lru_cache(maxsize=None)
def _marker(ch: str) -> str:
    return marker(ch)


def plain_punctuation(text: Column) -> Column:
    """Curly quotes, dashes, Ethiopic and Arabic punctuation to ASCII; all in the JVM."""
    return F.replace(F.translate(text, "".join(_ONE_TO_ONE) + _DELETED, "".join(_ONE_TO_ONE.values())), F.lit("…"), F.lit("..."))


def composed_and_marked(text: Column) -> Column:
    """Compatibility composition, ASCII punctuation and markers in one pass over the batch."""
    return _composed_and_marked(valid(text))


@F.arrow_udf(StringType())
def _composed_and_marked(col: pa.Array) -> pa.Array:

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        t = unicodedata.normalize("NFKC", t).translate(_TABLE)
        return t if t.isascii() else "".join(c if ord(c) < 127 else _marker(c) for c in t)

    return pa.array([one(t) for t in col.to_pylist()], pa.string())


def without_links(text: Column) -> Column:
    """Links, handles and hashtags to a space."""
    t = replace_all(text, r"https?://{NS}+|www\.{NS}+", " ", "iu")
    return replace_all(replace_all(t, r"@{W}+"), r"#{W}+")


def normalised(text: Column) -> Column:
    """The whole normaliser."""
    return collapse(composed_and_marked(without_links(F.coalesce(text, F.lit("")))))


def units(text: Column) -> Column:
    """Atomic units in order; a line break is no unit."""
    return F.regexp_extract_all(text, F.lit(rules.UNIT), F.lit(0))


def atomic_length(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rules.UNIT)), F.lit(0)).cast("bigint")


def masked(text: Column) -> Column:
    """Markers to stand-ins."""
    return F.regexp_replace(text, F.lit(rules.MARKER), F.lit("__U_$1__"))


def marker_dictionary(texts: DataFrame, col: str) -> DataFrame:
    """(placeholder, marker) of all texts; of several markers for one code point the largest stays."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(rules.MARKER), F.lit(0))).alias("marker"))
    keyed = found.select(F.concat(F.lit("__U_"), F.regexp_extract("marker", rules.MARKER, 1), F.lit("__")).alias("placeholder"), "marker")
    return keyed.groupBy("placeholder").agg(F.max("marker").alias("marker"))


def unmask_tokens(tokens: DataFrame, dictionary: DataFrame, col: str = "token") -> DataFrame:
    """Stand-ins in a token column back to their markers; the dictionary has a row per code point, so at most 1.1 million."""
    each = tokens.select(F.col(col).alias("_token")).distinct()
    parts = each.select("_token", F.posexplode(F.regexp_extract_all("_token", F.lit(f"{rules.PLACEHOLDER}|(?s:.)"), F.lit(0))).alias("_pos", "_part"))
    known = parts.join(dictionary, parts["_part"] == dictionary["placeholder"], "left").withColumn("_part", F.coalesce("marker", "_part"))
    back = known.groupBy("_token").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_part"))), lambda x: x["_part"]), "").alias("_text"))
    keep = [c for c in tokens.columns if c != col]
    return tokens.join(back, tokens[col] == back["_token"], "left").select(*keep, F.coalesce("_text", F.col(col)).alias(col))


def marker_counts(texts: DataFrame, col: str, least: int = rules.LEAST_MARKER) -> DataFrame:
    """(placeholder, n) of stand-ins that occur at least ``least`` times."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(rules.PLACEHOLDER), F.lit(0))).alias("placeholder"))
    return found.groupBy("placeholder").agg(F.count("*").alias("n")).where(F.col("n") >= least)


@F.arrow_udf(StringType())
def _ascii_letters(col: pa.Array) -> pa.Array:
    def one(t: str | None) -> str | None:
        return None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()

    return pa.array([one(t) for t in col.to_pylist()], pa.string())


def file_key(name: Column) -> Column:
    """Base name of a file without data-set suffixes, as bare ASCII letters and digits."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")
    short = F.regexp_replace(F.lower(_ascii_letters(valid(F.lower(F.regexp_replace(base, F.lit(rules.SUFFIX), F.lit("")))))), "[^a-z0-9]", "")
    return F.when(short != "", short).otherwise(F.lower(base))

