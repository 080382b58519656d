from __future__ import annotations

import os

import duckdb
import pytest

from corpusloom.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = con.execute(catalogue.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    wanted = sorted(repr(tuple(r[have.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_registered_queries_train_the_whole_vocabulary(spark, sf_dir, monkeypatch):
    from corpusloom.functions import rules

    sizes = []
    train = catalogue.bpe.train
    monkeypatch.setattr(catalogue.bpe, "train", lambda lines, size=rules.VOCABULARY, **more: sizes.append(size) or train(lines, 200, **more))
    for name in ("bpe_vocabulary", "encode_tokens", "decode_roundtrip", "benchmark_report"):
        catalogue.queries()[name](spark, sf_dir)
    assert sizes == [20_000] * 4


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_windowed_words_drop_late_rows(spark, tmp_path):
    from corpusloom.streaming.streams import to_table, windowed_words

    rows = [("2024-01-01 10:00:00", "a b"), ("2024-01-01 11:00:00", "a"), ("2024-01-09 00:00:00", "z"), (None, "n")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "t string, text string").selectExpr("cast(t as timestamp) as t", "text").write.parquet(src)
    stream = spark.readStream.schema("t timestamp, text string").parquet(src)
    out = windowed_words(stream, "t").selectExpr("window.start as start", "surface", "n")
    to_table(out, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {(r["surface"], r["n"]) for r in spark.read.schema("start timestamp, surface string, n bigint").parquet(str(tmp_path / "out")).collect()}
    assert ("a", 2) in got and (" b", 1) in got and ("n", 1) not in got
