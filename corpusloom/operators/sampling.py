"""Balanced sampling, shuffling and summaries of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import rules
from corpusloom.functions.regexkit import NS
from corpusloom.runtime import materialise


def draw_key(seed: int, *cols: str) -> Column:
    """Reproducible order of rows, whatever their partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def counts_per_file(df: DataFrame, file: str = "file") -> DataFrame:
    return df.groupBy(file).agg(F.count("*").alias("n"))


#: Leading hexadecimal digits of a draw key that are counted to find where a sample ends: 65,536 buckets.
DIGITS = 4


def smallest(df: DataFrame, key: tuple[str, ...], by: tuple[str, ...], quota, seed: int) -> DataFrame:
    """The rows of each group with the smallest draw keys, as many as ``quota(histogram)`` says (a number, after one look at the counts).

    Draw keys are counted by their first digits; whole buckets below the one in which a sample ends are kept by a filter,
    and only that bucket, a 65,536th of the group, is put in order. Nothing else is sorted or shuffled.
    """
    keyed = df.withColumn("_draw", draw_key(seed, *key)).withColumn("_bucket", F.substring("_draw", 1, DIGITS))
    counts = materialise(keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")), "draws")
    most = quota(counts)
    run = Window.partitionBy(*by).orderBy("_bucket")  # at most 65,536 rows a group
    before = counts.withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
    edge = before.where((F.col("_before") < most) & (F.col("_before") + F.col("_n") >= most)).select(*by, F.col("_bucket").alias("_edge"), (F.lit(most) - F.col("_before")).alias("_room"))
    if by:
        marked = keyed.join(F.broadcast(edge), list(by), "left")  # a row a group
    elif (end := edge.first()) is None:
        return df
    else:
        marked = keyed.withColumns({"_edge": F.lit(end["_edge"]), "_room": F.lit(end["_room"])})
    below = marked.where(F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    last = Window.partitionBy(*by).orderBy("_draw", *key)
    at = marked.where(F.col("_bucket") == F.col("_edge")).withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= F.col("_room")).drop("_n")
    return below.unionByName(at).select(*df.columns)


def balanced(df: DataFrame, key: tuple[str, ...], file: str = "file", seed: int = rules.SEED) -> DataFrame:
    """As many rows of each file as the smallest one has, drawn by ``draw_key`` over ``key``; see ``smallest``."""
    return smallest(df, key, (file,), lambda counts: counts.groupBy(file).agg(F.sum("_n").alias("n")).agg(F.min("n")).first()[0] or 0, seed)


def shuffled(df: DataFrame, key: tuple[str, ...], seed: int = rules.SEED) -> DataFrame:
    """One seeded order over everything: a range-partitioned sort, so no task holds it all."""
    return df.orderBy(draw_key(seed, *key), *key)


def subsample(df: DataFrame, key: tuple[str, ...], ratio: float, seed: int = rules.SEED) -> DataFrame:
    """max(1, int(n * ratio)) rows, those with the smallest draw keys; everything at a ratio of 1 or more; nothing of nothing. See ``smallest``."""
    if ratio >= 1:
        return df
    return smallest(df, key, (), lambda counts: max(1, int((counts.agg(F.sum("_n")).first()[0] or 0) * ratio)), seed)


def word_number(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(text, F.lit(f"{NS}+"))


def corpus_summary(sampled: DataFrame, totals: DataFrame, text: str = "sentence", file: str = "file") -> DataFrame:
    """One row per file and one of all (file null): sentences in total and sampled, words, characters and bytes with a line break each."""
    own = sampled.groupBy(file).agg(
        F.count("*").alias("sampled"), F.sum(word_number(F.col(text))).alias("words"), F.sum(F.length(text) + 1).alias("chars"), F.sum(F.octet_length(text) + 1).alias("bytes")
    )
    each = totals.select(file, F.col("n").alias("total")).join(own, file, "left").fillna(0)
    return each.rollup(file).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("total", "sampled", "words", "chars", "bytes")])


def family_summary(lines: DataFrame, text: str = "text", file: str = "file", family: str = "family") -> DataFrame:
    """Per family and in all (family null): sources, chunks, words, characters and bytes of the joined paragraph."""
    each = lines.where(F.col(family).isNotNull()).groupBy(family).agg(
        F.countDistinct(file).alias("sources"), F.count("*").alias("chunks"), F.sum(word_number(F.col(text))).alias("words"),
        (F.sum(F.length(text) + 1) - 1).alias("chars"), (F.sum(F.octet_length(text) + 1) - 1).alias("bytes"),
    )
    return each.rollup(family).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("sources", "chunks", "words", "chars", "bytes")])
