from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import normalize as nz
from corpusloom.functions import rules


def run(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


def slow(text):
    """The normaliser, one string at a time."""
    t = re.sub(r"https?://\S+|www\.\S+", " ", text or "", flags=re.I)
    t = re.sub(r"#\w+", " ", re.sub(r"@\w+", " ", t))
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        for a, b in rules.PUNCTUATION.items():
            t = t.replace(a, b)
        if not t.isascii():
            t = "".join(c if ord(c) < 127 else nz.marker(c) for c in t)
    return re.sub(r"\s+", " ", t).strip()


def test_goldens(spark):
    assert run(spark, nz.normalised, ["Café…"]) == ["Caf[U+00E9 LATIN SMALL LETTER E WITH ACUTE]..."]
    assert run(spark, lambda c: nz.masked(c), ["Caf[U+00E9 LATIN SMALL LETTER E WITH ACUTE]"]) == ["Caf__U_00E9__"]
    assert run(spark, nz.atomic_length, ["Caf__U_00E9__", "Caf[U+00E9 X]", "a\nb", "", None, "😀\r"]) == [4, 4, 2, 0, 0, 2]


def test_normaliser_equals_slow(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/preprocess_text.parquet").select("text").collect()]
    texts += [None, "", " \t", "a\x7f", "é\x7f", "x" * 100_000 + "é", "“a” – b ، ـ ፡፡"]
    assert run(spark, nz.normalised, texts) == [slow(t) for t in texts]


def test_markers(spark):
    df = spark.createDataFrame([("é é é ö ö",), ("é",), (None,)], "t string").select(nz.masked(nz.normalised(F.col("t"))).alias("t"))
    assert {(r[0], r[1]) for r in nz.marker_counts(df, "t").collect()} == {("__U_00E9__", 4)}
    names = spark.createDataFrame([("[U+00E9 A] [U+00E9 B]",)], "t string")
    d = nz.marker_dictionary(names, "t")
    assert [tuple(r) for r in d.collect()] == [("__U_00E9__", "[U+00E9 B]")]
    back = nz.unmask_tokens(spark.createDataFrame([(0, "a__U_00E9__"), (1, "b"), (2, "__U_0041__")], "id int, token string"), d)
    assert {tuple(r) for r in back.collect()} == {(0, "a[U+00E9 B]"), (1, "b"), (2, "__U_0041__")}


def test_plain_punctuation(spark):
    assert run(spark, nz.plain_punctuation, ["“a” … ‘b’ ـx።"]) == ['"a" ... \'b\' x.']


def test_file_key(spark):
    assert run(spark, nz.file_key, ["isiXhosa_dataset.txt", "x/Émile_clean.txt", "___.txt"]) == ["isixhosa", "emile", "___"]
