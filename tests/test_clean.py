from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import clean


def run(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    return [r["o"] for r in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("step", "given", "wanted"),
    [
        ("newlines", "a\r\nb\n\nc", "a b c"),
        ("tags", "x <b>y</b> [photo: 1] ![a](b) [t](http://x.y) [watch] image not found z", "x" + " " * 2 + "y" + " " * 12 + "z"),
        ("urls", "see https://a.b/c?d and www.x.y now", "see   and   now"),
        ("floods", "wow!!!! ---- ok!!!", "wow    ok!!!"),
        ("handles", "@bob hi bob@mail.com", "  hi bob .com"),
        ("hashtags", "a #tag#b c", "a    c"),
        ("emails", "to bob@mail.com.", "to  ."),
        ("ipv4", "ip 127.0.0.1 999.1.1.1", "ip   999.1.1.1"),
        ("cards", "n 1234-5678 1234-5678 x", "n   x"),
        ("phones", "c +1 202-555-0182 x", "c   x"),
        ("spam", "source:x source: x Subscribe now", " x source: x   now"),
        ("spam", "جميع الحقوق محفوظة x", "  x"),
    ],
)
def test_removals(spark, step, given, wanted):
    assert run(spark, lambda c: clean.removed(c, step), [given]) == [wanted]


def test_token_filter_goldens(spark):
    cases = {
        "I met 3amer in 2022 at COVID-19 hhhhhhh JavaScript facebook -": "I met 3amer in at COVID-19 -",
        "-5 12/34 100-19": "",
        "soooo sooooo": "soooo",
        "JavaScript YouTube NASA2024 McDonald": "NASA2024",
        "½ ² —": "½ —",
    }
    assert run(spark, clean.token_filter, list(cases)) == list(cases.values())


def test_cleaner_edges(spark):
    long = "neno " * 50_000
    out = run(spark, clean.cleaned, [None, "", "  \n", "a &amp; b &lt;i&gt; c", "bob@mail.com", long])
    assert out == ["", "", "", "a b c", "bob .com", long.strip()]


def test_unescape_equals_library(spark):
    texts = ["&eacute; &#233; &#xe9; &copy &notit; &", None, "plain", "&amp;lt;"]
    assert run(spark, clean.unescaped, texts) == [None if t is None else html.unescape(t) for t in texts]


def test_mixed_words(spark):
    assert run(spark, clean.has_letter_and_digit, ["3amer", "abc", "12", "a²"]) == [True, False, False, True]


def test_classes_equal_python(spark):
    """The word and space classes mean what Python's do."""
    from corpusloom.functions.regexkit import S, W

    probe = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in probe], "c string")
    got = {r["c"]: (r["w"], r["s"]) for r in df.select("c", F.col("c").rlike(f"^{W}$").alias("w"), F.col("c").rlike(f"^{S}$").alias("s")).collect()}
    odd = [c for c in probe if got[c][1] != bool(re.match(r"\s", c))]
    assert not odd
    assert sum(got[c][0] != bool(re.match(r"\w", c)) for c in probe) < 120  # code points newer than the JVM's tables
