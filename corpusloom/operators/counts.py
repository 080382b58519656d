"""Clauses, word surfaces, symbol pairs and their weighted counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.normalize import units
from corpusloom.functions.regexkit import S, digit_class, strip

# Fixed value: what ends a clause.
CLAUSE = rf"[\r\n\t]+|[.!?…:;\"«»—–]+|(?<={S})['’]|['’](?={S})"


def clauses(text: Column) -> Column:
    """Untrimmed clauses of a text; a comma doesn't split."""
    return F.split(text, CLAUSE, -1)


def surfaces(clause: Column) -> Column:
    """Words of a clause as counted: a space in front unless first; positions count every part; numbers are no words."""
    parts = F.split(strip(clause), " ", -1)
    words = F.transform(parts, lambda w, i: F.when((w != "") & ~w.rlike(f"^[{digit_class()}]+$"), F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w)))
    return F.filter(words, lambda w: w.isNotNull())


def word_counts(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., surface, n)."""
    words = df.select(*by, F.explode(clauses(F.col(text))).alias("_c")).select(*by, F.explode(surfaces(F.col("_c"))).alias("surface"))
    return words.groupBy(*by, "surface").agg(F.count("*").alias("n"))


def weighted_units(words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., units, n) of surfaces with at least two units."""
    return words.select(*by, units(F.col("surface")).alias("units"), "n").where(F.size("units") >= 2)


def pair_counts(weighted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., left, right, weight) of adjacent units; runs count each neighbourhood."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("units") - 2), lambda i: F.struct(F.col("units")[i].alias("left"), F.col("units")[i + 1].alias("right")))
    each = weighted.where(F.size("units") >= 2).select(*by, F.explode(pairs).alias("_p"), "n")
    return each.groupBy(*by, F.col("_p.left").alias("left"), F.col("_p.right").alias("right")).agg(F.sum("n").alias("weight"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k heaviest pairs; ties by left, then right."""
    return pairs.orderBy(F.desc("weight"), "left", "right").limit(k)


def clause_counts(df: DataFrame, text: str = "text", by: tuple[str, ...] = (), least: int = 2, least_words: int = 2) -> DataFrame:
    """(by..., words, n) of clauses with two untrimmed parts and ``least_words`` surfaces that occur at least ``least`` times."""
    each = df.select(*by, F.explode(clauses(F.col(text))).alias("clause")).where(F.size(F.split("clause", " ", -1)) >= 2)
    each = each.select(*by, surfaces(F.col("clause")).alias("words")).where(F.size("words") >= least_words)
    return each.groupBy(*by, "words").agg(F.count("*").alias("n")).where(F.col("n") >= least)
