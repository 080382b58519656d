from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.classify import alias_table
from corpusloom.sources import files, vocabulary
from corpusloom.sources.console import build, main


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "swahili_webtext_1.txt").write_bytes("Habari yako. Jambo leo!\n\n  Karibu sana \r\n".encode() + b"bad \xff byte here\n")
    (tmp_path / "hausa.TXT").write_text("Sannu da zuwa.\nIna kwana?\nLafiya lau.\n")
    (tmp_path / "misc.txt").write_text("what is this\n")
    (tmp_path / "bantou.txt").write_text("made\n")
    (tmp_path / "languages.txt").write_text("made\n")
    (tmp_path / "notes.md").write_text("no\n")
    return tmp_path


def test_discovery_tiers(spark, folder):
    aliases = alias_table(spark)
    names = [r["file"] for r in files.dataset_files(spark, str(folder), aliases).collect()]
    assert names == ["hausa.TXT", "swahili_webtext_1.txt"]
    for n in ("swahili_webtext_1.txt", "hausa.TXT"):
        (folder / n).unlink()
    assert [r["file"] for r in files.dataset_files(spark, str(folder), aliases).collect()] == ["bantou.txt"]
    (folder / "bantou.txt").unlink()
    assert [r["file"] for r in files.dataset_files(spark, str(folder), aliases).collect()] == ["misc.txt"]
    assert files.listed(spark, str(folder / "nowhere")).count() == 0


def test_lines(spark, folder):
    rows = files.lines(spark, str(folder / "swahili_webtext_1.txt")).collect()
    assert {r["line"] for r in rows} == {"Habari yako. Jambo leo!", "Karibu sana", "bad � byte here"}
    assert {r["file"] for r in rows} == {"swahili_webtext_1.txt"}


def test_resolve_and_first_folder_wins(spark, folder, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    (other / "misc.txt").write_text("other\n")
    got = {r["file"]: r["path"] for r in files.text_files(spark, [str(other), str(folder)]).collect()}
    assert str(other) in got["misc.txt"] and str(folder) in got["bantou.txt"]
    assert len(files.resolve(spark, "mis*.txt", [str(folder)])) == 1
    assert len(files.resolve(spark, "nothing.txt", [str(folder)])) == 5
    assert len(files.resolve(spark, str(folder / "misc.txt"), [])) == 1
    assert len(files.resolve(spark, str(folder), [])) == 5


def test_vocabulary_layouts(spark, tmp_path):
    flat, nested = tmp_path / "flat.json", tmp_path / "nested.json"
    flat.write_text(json.dumps({"a": 0, "é": 1}))
    nested.write_text(json.dumps({"vocab": {"0": "a", "1": "é"}}))
    a, b = (vocabulary.read_vocabulary(spark, str(p)) for p in (flat, nested))
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()] == [(0, "a"), (1, "é")]
    vocabulary.write_vocabulary(a, str(tmp_path / "out.json"))
    assert (tmp_path / "out.json").read_text() == '{\n  "a": 0,\n  "\\u00e9": 1\n}'
    assert vocabulary.read_vocabulary(spark, "flat.json", (str(tmp_path),)).count() == 2
    with pytest.raises(FileNotFoundError):
        vocabulary.read_vocabulary(spark, "none.json")


def test_build(spark, folder, tmp_path):
    out = str(tmp_path / "corpus")
    rows = {r["file"]: r for r in build(spark, str(folder), out).collect()}
    assert rows["hausa.TXT"]["sampled"] == rows["swahili_webtext_1.txt"]["sampled"] == 3
    text = spark.read.text(out)
    assert text.count() == 6 and rows[None]["chars"] == text.agg(F.sum(F.length("value") + 1)).first()[0]


def test_family_paragraphs(spark):
    df = spark.createDataFrame([("kwa", 2, "b"), ("kwa", 1, "a"), (None, 3, "c")], "family string, n int, text string")
    assert [tuple(r) for r in files.family_paragraphs(df, ("n",)).collect()] == [("kwa", "a b")]


def test_command_line(spark, folder, tmp_path, capsys):
    main(["train", "--data-dir", str(folder), "--vocab-size", "120", "--output", str(tmp_path / "t.json")])
    assert len(json.loads((tmp_path / "t.json").read_text())) <= 120
    main(["evaluate", "misc.txt", "--tokenizer", str(tmp_path / "t.json"), "--dir", str(folder)])
    assert "misc.txt" in capsys.readouterr().out
