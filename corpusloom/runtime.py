"""Helpers every operator shares: shared checkpoint folder, task spreading, heavy hitters."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least this share of all rows is "heavy"; there can be at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1e-3


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session; a folder of this machine in local mode (tests) only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-checkpoint")
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Give a scan with fewer tasks than cores more of them; a scan that is already wide isn't shuffled.

    For plans without a shuffle only: counting the tasks of one with a shuffle would run it. ``df.rdd`` gives the number of
    tasks here and no data passes through it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * factor)


def heavy_keys(counts: DataFrame, key: str, weight: str) -> dict:
    """{key: share} of the keys (one row each in ``counts``) with at least ``HEAVY_SHARE`` of the rows: at most 1 / HEAVY_SHARE of them, at any size."""
    total = counts.agg(F.sum(weight).alias("n")).first()["n"] or 0
    edge = max(2, math.ceil(total * HEAVY_SHARE))
    return {r[0]: r[1] / total for r in counts.where(F.col(weight) >= F.lit(edge)).select(key, weight).collect()}


def join_on_skewed_key(rows: DataFrame, lookup: DataFrame, key: str, heavy: dict, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup`` on ``key``; ``heavy`` from ``heavy_keys`` over the rows' keys.

    A heavy key is salted: its rows are dealt out by the hash of all their columns to about as many tasks as its
    share of all tasks, and its lookup rows are repeated so often. No task gets more than about a thousandth of the
    rows above its fair share, nothing but the at most 1000 keys is broadcast, and the result is that of a plain join.
    """
    if not heavy:
        return rows.join(lookup, key, how)
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    salts = spark.createDataFrame([(k, 1 + math.ceil(share * tasks)) for k, share in heavy.items()], f"_key {dict(rows.dtypes)[key]}, _salts int")
    dealt = rows.join(F.broadcast(salts), F.col(key) == F.col("_key"), "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_salts"))).cast("int")).drop("_key", "_salts")
    repeated = lookup.join(F.broadcast(salts), F.col(key) == F.col("_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_key", "_salts")
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")


def valid(col: Column | str) -> Column:
    """Text for an Arrow step: bytes that are no UTF-8 become U+FFFD, as Python could not read them."""
    return F.make_valid_utf8(F.col(col) if isinstance(col, str) else col)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

