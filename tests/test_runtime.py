from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions import clean
from corpusloom.functions import normalize as nz
from corpusloom.operators import codec


def fake(master):
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)


def test_shared_folder_is_needed_off_local():
    assert runtime.shared_dir(fake("local[8]")).startswith("file:///") and runtime.shared_dir(fake("local")).startswith("file:///")
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(fake(master))


@pytest.mark.parametrize("rows", [900, 30_000])
def test_skewed_join_equals_plain_join_at_any_size(spark, rows):
    """A third of the rows has one key, another key has several lookup rows; the heavy way runs at every size."""
    left = spark.range(rows).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "warm").otherwise(F.col("id").cast("string")).alias("key"), "id")
    counts = left.groupBy("key").agg(F.count("*").alias("n"))
    lookup = counts.where("key <> '1'").unionByName(counts.where("key = 'warm'"))
    heavy = runtime.heavy_keys(counts, "key", "n")
    assert {"hot", "warm"} <= set(heavy) and len(heavy) <= 1 / runtime.HEAVY_SHARE and heavy["hot"] == pytest.approx(1 / 3, abs=0.01)
    got = runtime.join_on_skewed_key(left, lookup, "key", heavy)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(lookup, "key").collect()))
    assert runtime.join_on_skewed_key(left, lookup, "key", heavy, "left").count() == left.join(lookup, "key", "left").count()


def test_no_rows_have_no_heavy_keys(spark):
    none = spark.createDataFrame([], "key string, n bigint")
    assert runtime.heavy_keys(none, "key", "n") == {}


def test_bytes_that_are_no_text(spark):
    bad = spark.createDataFrame([(1, bytearray(b"a \xff\xc3 &amp; b")), (2, bytearray("\u00e9".encode())), (3, None)], "k int, b binary").select("k", F.col("b").cast("string").alias("t"))
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in bad.select("k", clean.unescaped("t").alias("a"), nz.normalised(F.col("t")).alias("b"), codec.encoder({"a": 5})("t").alias("c")).collect()}
    assert got[1][0] == "a \ufffd\ufffd & b" and got[1][1].startswith("a [U+FFFD") and got[1][2][0] == 5
    assert got[2][0] == "\u00e9" and got[3][0] is None
