"""Text files as tables: discovery by rules, lines, and the text sinks. Paths are explicit; nothing scans the working directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import rules
from corpusloom.functions.regexkit import strip
from corpusloom.operators.classify import file_families


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file) of the ``.txt`` files of a folder, by name; a missing folder gives no rows. Only names are read."""
    empty = spark.createDataFrame([], "path string, file string")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return empty
    names = [(s.getPath().toString(), s.getPath().getName()) for s in fs.listStatus(hadoop) if s.isFile() and s.getPath().getName().lower().endswith(".txt")]
    return spark.createDataFrame(names, empty.schema).orderBy("file") if names else empty


def dataset_files(spark: SparkSession, folder: str, aliases: DataFrame) -> DataFrame:
    """(path, file): the classified files; if there are none the generated family files; if none either, all."""
    files = listed(spark, folder).where(~F.lower("file").isin(list(rules.PASSED_OVER)))
    tiers = files.join(file_families(files, aliases).select("file", "family"), "file", "left")
    tiers = tiers.withColumn("_tier", F.when(F.col("family").isNotNull(), 1).when(F.lower("file").isin(list(rules.GENERATED)), 2).otherwise(3))
    best = tiers.agg(F.min("_tier")).first()[0]
    return tiers.where(F.col("_tier") == F.lit(best or 0)).select("path", "file").orderBy("file")


def text_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, file) over several folders; of equal names the one in the earlier folder counts."""
    out = None
    for rank, folder in enumerate(folders):
        one = listed(spark, folder).withColumn("_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "path string, file string")
    first = Window.partitionBy("file").orderBy("_rank", "path")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("path", "file").orderBy("file")


def resolve(spark: SparkSession, target: str, folders: list[str]) -> list[str]:
    """Files a name stands for: a path, a folder's files, a name or glob in the folders in order, else all files of the folders."""
    jvm = spark.sparkContext._jvm

    def found(pattern: str) -> list[str]:
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    hits = found(target) if "/" in target else []
    if len(hits) == 1 and not target.lower().endswith(".txt"):
        return [r["path"] for r in listed(spark, target).collect()]
    for folder in folders if not hits else ():
        hits = [h for h in found(f"{folder}/{target}") if h.lower().endswith(".txt")]
        if hits:
            break
    return hits or [r["path"] for r in text_files(spark, folders).collect()]


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line): stripped lines of text files, blank ones dropped; bad bytes become U+FFFD."""
    raw = spark.read.text(paths)
    out = raw.select(F.col("_metadata.file_name").alias("file"), strip(F.make_valid_utf8("value")).alias("line"))
    return out.where("line <> ''")


def write_corpus(df: DataFrame, path: str, text: str = "sentence", single: bool = False) -> None:
    """One text per line, in the order of ``df``; ``single`` for one file (small corpora only)."""
    (df.coalesce(1) if single else df).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_families(df: DataFrame, path: str, text: str = "text", family: str = "family") -> None:
    """A folder per family with its texts in order; joined by spaces they are the family's paragraph.

    A paragraph of one line doesn't scale with a corpus, so each part file holds a line-separated piece of it.
    """
    df.where(F.col(family).isNotNull()).select(F.col(text).alias("value"), F.col(family).alias("family")).write.mode("overwrite").partitionBy("family").text(path)


def family_paragraphs(df: DataFrame, order: tuple[str, ...], text: str = "text", family: str = "family") -> DataFrame:
    """(family, paragraph): all texts of a family joined by single spaces, in order. For families that fit one row."""
    row = F.struct(*order, F.col(text).alias("_t"))
    return df.where(F.col(family).isNotNull()).groupBy(family).agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["_t"]), " ").alias("paragraph"))
