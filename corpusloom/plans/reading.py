"""Queries of the file sources: the table languages is written as one text file per ``file`` and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.classify import alias_table
from corpusloom.plans.sqltext import S, lit, strip
from corpusloom.runtime import scratch, table
from corpusloom.sources.files import dataset_files, lines, resolve, text_files

#: A glob of file names, and what it stands for in SQL.
GLOB, LIKE = "*_school_*.txt", "%\\_school\\_%.txt"


def text_folder(spark: SparkSession, sf_dir: str) -> str:
    """A fresh folder with the texts of each file of the table; texts with line breaks become several lines."""
    parts, folder = scratch(spark, "text-parts"), scratch(spark, "texts")
    rows = table(spark, sf_dir, "languages").where("text IS NOT NULL AND file IS NOT NULL")
    rows.select("text", F.col("file").alias("name")).repartition("name").write.partitionBy("name").text(parts)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(folder))
    for status in fs.globStatus(hadoop.Path(f"{parts}/name=*/part-*")):
        path = status.getPath()
        fs.rename(path, hadoop.Path(f"{folder}/{path.getParent().getName().removeprefix('name=')}"))
    return folder


def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified files of a folder."""
    return dataset_files(spark, text_folder(spark, sf_dir), alias_table(spark)).select("file")


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped lines that aren't blank, with how often each stands in its file."""
    return lines(spark, text_folder(spark, sf_dir)).groupBy("file", "line").agg(F.count("*").alias("n"))


def first_folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files over two folders that hold the same names; each comes from the first, once."""
    one, two = text_folder(spark, sf_dir), text_folder(spark, sf_dir)
    return text_files(spark, [one, two]).select("file", F.col("path").contains(one.rsplit("/", 1)[-1]).alias("first"))


def resolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a glob stands for."""
    paths = resolve(spark, GLOB, [text_folder(spark, sf_dir)])
    return spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in paths], "file string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (discovered_files, file_lines, first_folder_files, resolved_files)}


def oracle_sql(families: str) -> dict[str, str]:
    """``families``: SQL of (file, family) over dataset_files."""
    files = "SELECT DISTINCT file FROM languages WHERE text IS NOT NULL AND file IS NOT NULL"
    split = lit(r"\r\n|\n|\r")
    return {
        "discovered_files": f"SELECT file FROM ({families}) WHERE family IS NOT NULL AND file IN ({files})",
        "file_lines": f"WITH l AS (SELECT file, unnest(regexp_split_to_array(text, {split})) AS t FROM languages WHERE text IS NOT NULL), s AS (SELECT file, {strip('t')} AS line FROM l) SELECT file, line, count(*) AS n FROM s WHERE NOT regexp_matches(line, {lit(f'^{S}*$')}) GROUP BY file, line",
        "first_folder_files": f"SELECT file, true AS first FROM ({files})",
        "resolved_files": f"SELECT file FROM ({files}) WHERE file LIKE {lit(LIKE)} ESCAPE {lit(chr(92))}",
    }
