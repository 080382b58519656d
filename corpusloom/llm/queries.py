"""Queries of the ten training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.chunk_encode import encoded
from corpusloom.llm.format_ledger import copies, ledger_of
from corpusloom.llm.leak_scan import leaks
from corpusloom.llm.language_ppm import fit, segments
from corpusloom.llm.mixing import Mixture
from corpusloom.llm.page_spam import judged, profiles
from corpusloom.llm.personal_data import personal_data
from corpusloom.llm.residue import residue
from corpusloom.llm.sentence_bounds import sentences
from corpusloom.llm.unicode_form import consistent_form, look_alike_pairs, look_alikes

TYPOLOGIES = ["agglutination", "fusional", "analytic"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = look_alike_pairs(_read(spark, sf_dir, "preprocess_text"), "text_id", "text")
    return pairs.select(F.col("a").alias("text_id_a"), F.col("b").alias("text_id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that look like another string: class, string and number of links."""
    return look_alikes(_read(spark, sf_dir, "preprocess_text"), "text_id", "text").withColumnRenamed("id", "text_id")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "preprocess_text").select("text_id", consistent_form("text").alias("text"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_read(spark, sf_dir, "clean_raw_dataset_text"), "line_id", "text", _read(spark, sf_dir, "person_names"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select(F.col("id").alias("line_id"), F.explode("kinds").alias("kind"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select(F.col("id").alias("line_id"), F.col("redacted").alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(_read(spark, sf_dir, "clean_raw_dataset_text"), "line_id", "text").select(F.col("id").alias("line_id"), "end_char")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(_read(spark, sf_dir, "clean_raw_dataset_text"), "line_id", "text").withColumnRenamed("id", "line_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(_read(spark, sf_dir, "clean_raw_dataset_text"), "line_id", "text").where("is_residue").select(F.col("id").alias("line_id"))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    files = _read(spark, sf_dir, "dataset_files").select("file", F.col("typology").alias("source"))
    rows = _read(spark, sf_dir, "preprocess_text").join(F.broadcast(files), "file")  # dataset_files is fixed: 56 rows
    rows = rows.select("source", F.col("text_id").alias("row_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))
    return Mixture(rows, _read(spark, sf_dir, "typology_budget_ratios"), TYPOLOGIES)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().withColumnRenamed("source", "typology")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().where("short").select("mix_id", F.col("source").alias("typology"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of all mixes: every piece of every slot, with its text."""
    texts = _read(spark, sf_dir, "preprocess_text").select(F.col("text_id").alias("row_id"), "text")
    return _mixture(spark, sf_dir).records(texts).withColumnRenamed("source", "typology")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(profiles(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "language_samples"), label_col="lang"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).where(~F.col("spam") & (F.size("found") > 0))
    whole = F.filter("found", lambda x: x["sentences"] >= 2)
    langs = F.when(F.size(whole) >= 2, F.transform(whole, lambda x: x["lang"])).otherwise(F.array("lang"))
    label = F.lower(F.trim(F.regexp_replace("label", r"\s+", " ")))
    rows = rows.select("id", label.alias("label"), "found", langs.alias("langs")).where((F.size("langs") >= 2) | ~F.coalesce(F.array_contains("langs", F.col("label")), F.lit(False)))
    return rows.select(F.col("id").alias("doc_id"), F.explode("langs").alias("lang"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(_read(spark, sf_dir, "documents"), fit(_read(spark, sf_dir, "language_samples"))).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("spam").select(F.col("id").alias("doc_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "languages")
    return copies(rows, "sent_id", "text", [F.col("added_at").isNotNull(), F.col("added_at").isNull()])


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger = ledger_of(_read(spark, sf_dir, "languages"), "sent_id", "text", [F.col("added_at").isNotNull(), F.col("added_at").isNull()])
    return ledger.counts().select("first_id", F.col("n").alias("copies"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_read(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark_items")).select("item_id", "doc_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark_items"), exact=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_classes, p1_forms, p2_found, p2_redacted, p3_found, p3_report, p3_records, p4_found, p4_sentences, p5_found, p6_found, p6_segments, p7_found, p7_counts, p8_ids, p9_found, p9_near, p10_found)
    return {f.__name__: f for f in own}


def _records_sql() -> str:
    """CTEs that end in ``keyed`` with (sent_id, key): named fields sorted, the rest bare letters, marks and digits."""
    bare = lambda x: f"lower(upper(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')))"
    name = "[\\p{L}\\p{M}_][\\p{L}\\p{M}\\p{N}_ ]*\\s*:"
    parts = f"string_split(regexp_replace(text, '\\s*[|;\\n]+\\s*({name})', chr(30) || '\\1', 'g'), chr(30))"
    pair = f"{bare('split_part(x, chr(58), 1)')} || chr(31) || {bare('substr(x, strpos(x, chr(58)) + 1)')}"
    field = f"{bare('x')} || chr(31) || {bare(chr(99) + 'oalesce(json_extract_string(text, chr(36) || chr(46) || chr(34) || x || chr(34)), chr(32))')}"
    return (
        "WITH rows AS (SELECT sent_id, text FROM languages WHERE text IS NOT NULL), "
        f"kinds AS (SELECT *, {bare('text')} AS plain, regexp_matches(text, '(?s)^\\s*\\{{.*\\}}\\s*$') AND json_valid(text) AS is_json, regexp_matches(text, '(?s)^\\s*{name}.*?[|;\\n]\\s*{name}.*$') AS is_record FROM rows), "
        f"keyed AS (SELECT sent_id, CASE WHEN is_json THEN array_to_string(list_sort(list_transform(json_keys(CASE WHEN is_json THEN text END), lambda x: {field})), chr(30)) "
        f"WHEN is_record THEN array_to_string(list_sort(list_transform({parts}, lambda x: {pair})), chr(30)) ELSE plain END AS key FROM kinds WHERE plain <> '')"
    )


def _windows_sql(table: str, key: str, size: int) -> str:
    """(key, w) of all runs of ``size`` words of a table, without case, accents' spelling, punctuation and marks inside words."""
    words = "regexp_extract_all(nfc_normalize(lower(regexp_replace(text, '[\\p{Cf}''’‘ʼ`´]', '', 'g'))), '[\\p{L}\\p{M}\\p{N}]+')"
    return (
        f"SELECT DISTINCT {key}, w FROM (SELECT {key}, unnest(list_transform(range(1, len(l) - {size - 2}), lambda i: array_to_string(l[i:i + {size - 1}], ' '))) AS w "
        f"FROM (SELECT {key}, {words} AS l FROM {table} WHERE text IS NOT NULL))"
    )


def oracle_sql() -> dict[str, str]:
    shares = " UNION ALL ".join(f"SELECT mix_id, '{t}' AS typology, {t} AS share, size_factor, max_repeats FROM typology_budget_ratios" for t in TYPOLOGIES)
    records = _records_sql()
    return {
        "p3_found": f"""
            WITH sizes AS (SELECT f.typology, sum(coalesce(length(p.text), 0)) AS size
                           FROM preprocess_text p JOIN dataset_files f USING (file) GROUP BY f.typology),
                 wanted AS ({shares})
            SELECT w.mix_id, w.typology FROM wanted w LEFT JOIN sizes s USING (typology)
            WHERE coalesce(s.size, 0) * w.max_repeats < w.share * w.size_factor * (SELECT sum(size) FROM sizes)""",
        "p7_found": f"{records}, firsts AS (SELECT sent_id, min(sent_id) OVER (PARTITION BY key) AS first_id FROM keyed) SELECT first_id, sent_id AS copy_id FROM firsts WHERE sent_id <> first_id",
        "p7_counts": f"{records} SELECT min(sent_id) AS first_id, count(*) AS copies FROM keyed GROUP BY key",
        "p9_found": f"WITH a AS ({_windows_sql('benchmark_items', 'item_id', 12)}), b AS ({_windows_sql('documents', 'doc_id', 12)}) SELECT DISTINCT item_id, doc_id FROM a JOIN b USING (w)",
    }
