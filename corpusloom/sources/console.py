"""Command line: ``build`` a balanced corpus, ``train`` a vocabulary, ``evaluate`` it; and aligned tables on the console."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators.bpe import train
from corpusloom.operators.classify import alias_table, file_families
from corpusloom.operators.evaluate import report
from corpusloom.operators.sampling import balanced, corpus_summary, counts_per_file, shuffled
from corpusloom.operators.sentences import corpus_sentences
from corpusloom.runtime import materialise
from corpusloom.sources.files import dataset_files, lines, resolve, text_files, write_corpus, write_families
from corpusloom.sources.vocabulary import read_vocabulary, write_vocabulary


def show(df: DataFrame, rows: int = 100) -> None:
    df.show(rows, truncate=False)


#: Copies of one sentence that a task writes out at once.
COPIES = 10_000


def numbered(sents: DataFrame) -> DataFrame:
    """(file, sentence, copy): equal sentences of a file are alike, so they are counted and numbered from 1.

    A line's place in its file isn't kept by a distributed read. A sentence that is repeated without end is
    counted on the map side and written out by many tasks.
    """
    each = sents.groupBy("file", "sentence").agg(F.count("*").alias("n"))
    parts = each.withColumn("_part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition("file", "sentence", "_part")
    return parts.select("file", "sentence", F.explode(F.sequence(F.col("_part") * COPIES + 1, F.least(F.col("n"), (F.col("_part") + 1) * COPIES))).alias("copy"))


def build(spark: SparkSession, folder: str, out: str, seed: int = rules.SEED, aliases: str | None = None, families: str | None = None) -> DataFrame:
    """Clean, split, draw evenly, shuffle, write; returns the summary. ``families``: where the family paragraphs go, if wanted."""
    known = alias_table(spark, aliases)
    files = dataset_files(spark, folder, known)
    paths = [r["path"] for r in files.collect()]
    if not paths:
        return spark.createDataFrame([], "file string, total bigint, sampled bigint, words bigint, chars bigint, bytes bigint")
    rows = lines(spark, paths)
    if families:
        named = file_families(files.select("file"), known).where("family IS NOT NULL").select("file", "family")
        write_families(rows.withColumnRenamed("line", "text").join(F.broadcast(named), "file"), families)  # a row a file
    sents = materialise(numbered(corpus_sentences(rows, "line", ("file",)).select("file", "sentence")), "sentences")
    totals = counts_per_file(sents)
    picked = balanced(sents, ("file", "sentence", "copy"), seed=seed)
    write_corpus(shuffled(picked, ("file", "sentence", "copy"), seed), out)
    return corpus_summary(picked, totals)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom")
    sub = parser.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("--input-dir", required=True)
    b.add_argument("--output", default="languages.txt")
    b.add_argument("--output-dir", default=None)
    b.add_argument("--aliases", default=None, help="JSON file of family to aliases")
    b.add_argument("--families", action="store_true", help="also write the family paragraphs, below the output folder")
    b.add_argument("--seed", type=int, default=rules.SEED)
    t = sub.add_parser("train")
    t.add_argument("--data-dir", required=True)
    t.add_argument("--vocab-size", type=int, default=rules.VOCABULARY)
    t.add_argument("--output", default="tokenizer.json")
    e = sub.add_parser("evaluate")
    e.add_argument("target")
    e.add_argument("--tokenizer", default="tokenizer.json")
    e.add_argument("--dir", default=".")
    e.add_argument("--sample-ratio", type=float, default=1.0)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.what == "build":
        folder = a.output_dir or (a.output.rsplit("/", 1)[0] if "/" in a.output else ".")
        out = f"{folder}/{a.output.rsplit('/', 1)[-1]}"
        show(build(spark, a.input_dir, out, a.seed, a.aliases, f"{folder}/families" if a.families else None))
    elif a.what == "train":
        paths = [r["path"] for r in text_files(spark, [a.data_dir]).collect()]
        write_vocabulary(train(lines(spark, paths), a.vocab_size, text="line"), a.output)
    else:
        rows = lines(spark, resolve(spark, a.target, [a.dir]))
        show(report(rows, read_vocabulary(spark, a.tokenizer), "line", ratio=a.sample_ratio, key=("file", "line")))


if __name__ == "__main__":
    main()
