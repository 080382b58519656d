"""Compression and round-trip report of a vocabulary on a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.normalize import atomic_length, normalised
from corpusloom.operators.codec import coded
from corpusloom.operators.sampling import subsample, word_number


def encoded_corpus(df: DataFrame, vocabulary: DataFrame | dict[str, int], text: str = "text", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keep..., text, ids, back): normalised non-empty texts, their ids and the decoded text."""
    return coded(df.select(*keep, normalised(F.col(text)).alias("text")), vocabulary)


def report(df: DataFrame, vocabulary: DataFrame | dict[str, int], text: str = "text", file: str = "file", ratio: float = 1.0, key: tuple[str, ...] = ()) -> DataFrame:
    """Per file and over all (file null): sums, ratios of sums and whether every text came back."""
    rows = subsample(df, key, ratio) if key else df
    each = encoded_corpus(rows, vocabulary, text, (file,))
    # measured once a text: a rollup repeats its rows, and a text that came back has its length
    sizes = each.select(file, (F.col("text") == F.col("back")).alias("same"), "back", word_number(F.col("text")).alias("words"), atomic_length(F.col("text")).alias("chars_in"), F.size("ids").alias("tokens"))
    sizes = sizes.select(file, F.col("same").cast("bigint").alias("same"), "words", "chars_in", F.when(F.col("same"), F.col("chars_in")).otherwise(atomic_length(F.col("back"))).alias("chars_out"), "tokens")
    sums = sizes.rollup(file).agg(
        F.count("*").alias("sentences"), F.sum("words").cast("bigint").alias("words"), F.sum("chars_in").alias("chars_in"),
        F.sum("chars_out").alias("chars_out"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("same").alias("exact"),
    )
    per = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), "tokens"), 6)
    return sums.select("*", per("chars_in").alias("chars_per_token"), per("words").alias("words_per_token"), ((F.col("exact") == F.col("sentences")) & (F.col("chars_in") == F.col("chars_out"))).alias("passed"))
