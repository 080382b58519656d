"""Queries of the engine's own operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import clean, rules
from corpusloom.functions import normalize as nz
from corpusloom.operators import bpe, classify, codec, counts, evaluate, sampling
from corpusloom.operators import sentences as sn
from corpusloom.plans import coding, reading
from corpusloom.plans import sqltext as sql
from corpusloom.runtime import scratch, spread, table

TOP = 100


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "clean_raw_dataset_text").select("line_id", "file", "text"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def word_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = counts.word_counts(_docs(spark, sf_dir))
    return n.orderBy(F.desc("n"), "surface").limit(TOP)


def pair_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = counts.weighted_units(counts.word_counts(_docs(spark, sf_dir)))
    return counts.top_pairs(counts.pair_counts(words), TOP)


def clause_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = counts.clause_counts(_docs(spark, sf_dir))
    return n.select(F.array_join("words", "").alias("clause"), F.size("words").alias("words"), "n")


def clean_step(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    return _raw(spark, sf_dir).select("line_id", clean.removed(F.col("text"), step).alias("text"))


def clean_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("line_id", clean.unescaped("text").alias("text"))


def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("line_id", clean.token_filter(F.coalesce("text", F.lit(""))).alias("text"))


def mixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _raw(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).where(clean.has_letter_and_digit(F.col("word")))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("line_id", clean.cleaned(F.col("text")).alias("text"))


def line_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.corpus_sentences(_raw(spark, sf_dir), "text", ("line_id",))


def sentences_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.counts_per_file(sn.corpus_sentences(_raw(spark, sf_dir), "text", ("file",)))


def repaired_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("line_id", sn.joined_lines(F.col("text")).alias("text"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the balanced-corpus table, uncleaned, with their keys."""
    rows = spread(table(spark, sf_dir, "languages").select("sent_id", "file", "text"))
    return sn.sentences(rows.where("text IS NOT NULL"), "text", ("sent_id", "file"))


KEY = ("file", "sent_id", "sent_no")


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced(_corpus(spark, sf_dir), KEY).select(*KEY, "sentence")


def shuffled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled sample; ``draw`` is the sort key of the order."""
    rows = sampling.shuffled(sampling.balanced(_corpus(spark, sf_dir), KEY), KEY)
    return rows.select(*KEY, sampling.draw_key(rules.SEED, *KEY).alias("draw"))


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    return sampling.corpus_summary(sampling.balanced(rows, KEY), sampling.counts_per_file(rows))


def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "dataset_files").select("file", "family")
    rows = table(spark, sf_dir, "preprocess_text").where("text IS NOT NULL").join(F.broadcast(files), "file")  # dataset_files is fixed: 56 rows
    return sampling.family_summary(rows)


def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "preprocess_text").select("text_id", nz.normalised(F.col("text")).alias("text"))


def plain_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "preprocess_text").select("text_id", nz.plain_punctuation(F.col("text")).alias("text"))


def without_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "preprocess_text").select("text_id", nz.without_links(F.col("text")).alias("text"))


def masked_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("line_id", nz.masked(F.col("text")).alias("text"))


def atomic_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("line_id", nz.atomic_length(F.col("text")).alias("units"))


def marker_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "preprocess_text").select(nz.masked(nz.normalised(F.col("text"))).alias("text"))
    return nz.marker_counts(lines, "text")


def typology_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataset_files").select("file", classify.name_typology(F.col("file")).alias("typology"))


def typology_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "preprocess_text").select("text_id", classify.line_typology(F.coalesce("text", F.lit(""))).alias("typology"))


def family_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.file_families(table(spark, sf_dir, "dataset_files").select("file"), classify.alias_table(spark))


def family_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = classify.family_files(table(spark, sf_dir, "dataset_files").select("file"), classify.alias_table(spark))
    return each.select("family", F.array_join("files", " ").alias("files"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "preprocess_text").where("text IS NOT NULL").select("file", "text"))
    return bpe.train(lines, rules.VOCABULARY)


def bpe_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "languages").select("sent_id", "text")).select("sent_id", nz.normalised(F.col("text")).alias("text"))
    return rows.select("sent_id", codec.encoder(_vocabulary(spark, sf_dir))("text").alias("ids"))


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "languages").select("sent_id", "text")
    back = evaluate.encoded_corpus(rows, _vocabulary(spark, sf_dir), keep=("sent_id",))
    return back.select("sent_id", (F.col("text") == F.col("back")).alias("exact"), F.size("ids").alias("tokens"))


def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(table(spark, sf_dir, "languages").select("file", "text"), _vocabulary(spark, sf_dir))


def char_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of whole documents with the characters of ASCII as vocabulary; others become token 0. Longer tokens: ``coding.fixed_codec``."""
    vocabulary = {chr(c): i for i, c in enumerate(rules.ASCII)}
    rows = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = codec.decoded(rows.withColumn("ids", codec.encoder(vocabulary)("text")), vocabulary, to="back")
    return back.select("doc_id", F.size("ids").alias("tokens"), "back")


def stream_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_sentences`` run as a stream over the table's files."""
    from corpusloom.streaming.streams import cleaned_sentences, to_table

    stream = spark.readStream.schema("line_id bigint, text string").parquet(f"{sf_dir}/clean_raw_dataset_text.parque[t]")  # a pattern, as a stream takes no single file
    out, mark = scratch(spark, "stream-out"), scratch(spark, "stream-mark")
    rows = cleaned_sentences(stream, "text", ("line_id",))
    to_table(rows, out, mark).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


_STEPS = {f"clean_{s}": s for s in clean.ORDER}
_OWN = (
    word_freq_topk, pair_counts_topk, clause_freq, clean_unescape, token_filter, mixed_words, clean_full, line_sentences, sentences_per_file, repaired_breaks, balanced_sample, shuffled_corpus, corpus_summary,
    family_summary, normalised_lines, plain_punctuation, without_links, masked_markers, atomic_lengths, marker_freq, typology_names, typology_lines, family_names, family_files, bpe_vocabulary, encode_tokens,
    decode_roundtrip, benchmark_report, char_codec, stream_sentences,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN} | {n: partial(clean_step, step=s) for n, s in _STEPS.items()} | coding.queries() | reading.queries()


def oracle_sql() -> dict[str, str]:
    lit, sub = sql.lit, sql.sub
    raw = "(SELECT line_id, file, text FROM clean_raw_dataset_text)"
    out = {n: f"SELECT line_id, {sql.removed('text', s)} AS text FROM clean_raw_dataset_text" for n, s in _STEPS.items()}
    words = f"WITH {sql.clause_ctes('documents')}, sf AS (SELECT unnest({sql.surface_list('clause')}) AS surface FROM cl), wc AS (SELECT surface, count(*) AS n FROM sf GROUP BY surface)"
    out["word_freq_topk"] = f"{words} SELECT surface, n FROM wc ORDER BY n DESC, surface LIMIT {TOP}"
    unit = lit(rules.UNIT)
    out["pair_counts_topk"] = (
        f"{words}, un AS (SELECT regexp_extract_all(surface, {unit}) AS u, n FROM wc), pr AS (SELECT unnest(list_zip(u[1:len(u) - 1], u[2:])) AS p, n FROM un WHERE len(u) >= 2) "
        f'SELECT p[1] AS "left", p[2] AS "right", CAST(sum(n) AS BIGINT) AS weight FROM pr GROUP BY 1, 2 ORDER BY weight DESC, 1, 2 LIMIT {TOP}'
    )
    out["clause_freq"] = (
        f"WITH {sql.clause_ctes('documents')}, w AS (SELECT {sql.surface_list('clause')} AS l FROM cl WHERE len(string_split(clause, ' ')) >= 2) "
        "SELECT array_to_string(l, '') AS clause, CAST(len(l) AS INTEGER) AS words, count(*) AS n FROM w WHERE len(l) >= 2 GROUP BY l HAVING count(*) >= 2"
    )
    out["clean_unescape"] = f"SELECT line_id, {sql.unescaped('text')} AS text FROM clean_raw_dataset_text"
    out["token_filter"] = f"SELECT line_id, {sql.token_filter('coalesce(text, ' + lit('') + ')')} AS text FROM clean_raw_dataset_text"
    digit = lit("[" + sql.digit_class() + "]")
    out["mixed_words"] = f"WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM clean_raw_dataset_text) SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '\\p{{L}}') AND regexp_matches(word, {digit}) GROUP BY word"
    out["clean_full"] = f"WITH {sql.cleaning_ctes(raw, 'line_id')} SELECT line_id, t AS text FROM cleaned"
    cut = f"WITH {sql.cleaning_ctes(raw, 'line_id, file')}, done AS (SELECT line_id, file, {sql.finished('t')} AS t FROM cleaned WHERE t <> ''), {sql.sentence_ctes('done', 'line_id, file', 't')}"
    out["line_sentences"] = out["stream_sentences"] = f"{cut} SELECT line_id, sent_no, sentence FROM sents"
    out["sentences_per_file"] = f"{cut} SELECT file, count(*) AS n FROM sents GROUP BY file"
    out["repaired_breaks"] = f"SELECT line_id, {sql.joined_lines('text')} AS text FROM clean_raw_dataset_text"
    corpus = f"WITH src AS (SELECT sent_id, file, text FROM languages WHERE text IS NOT NULL), {sql.sentence_ctes('src', 'sent_id, file', 'text')}"
    draw = f"md5(concat_ws('|', '{rules.SEED}', file, CAST(sent_id AS VARCHAR), CAST(sent_no AS VARCHAR)))"
    picked = (
        f"{corpus}, tot AS (SELECT file, count(*) AS total FROM sents GROUP BY file), ord AS (SELECT *, {draw} AS draw, row_number() OVER (PARTITION BY file ORDER BY {draw}, file, sent_id, sent_no) AS r FROM sents), "
        "pick AS (SELECT * FROM ord WHERE r <= (SELECT min(total) FROM tot))"
    )
    out["balanced_sample"] = f"{picked} SELECT file, sent_id, sent_no, sentence FROM pick"
    out["shuffled_corpus"] = f"{picked} SELECT file, sent_id, sent_no, draw FROM pick ORDER BY draw"
    nwords = f"len(regexp_extract_all(sentence, {lit(sql.NS + '+')}))"
    out["corpus_summary"] = (
        f"{picked}, own AS (SELECT file, count(*) AS sampled, sum({nwords}) AS words, sum(length(sentence) + 1) AS chars, sum(strlen(sentence) + 1) AS bytes FROM pick GROUP BY file), "
        "ea AS (SELECT tot.file, total, coalesce(sampled, 0) AS sampled, coalesce(words, 0) AS words, coalesce(chars, 0) AS chars, coalesce(bytes, 0) AS bytes FROM tot LEFT JOIN own USING (file)) "
        "SELECT file, CAST(sum(total) AS BIGINT) AS total, CAST(sum(sampled) AS BIGINT) AS sampled, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(bytes) AS BIGINT) AS bytes FROM ea GROUP BY ROLLUP (file)"
    )
    twords = nwords.replace("sentence", "text")
    out["family_summary"] = (
        f"WITH ea AS (SELECT family, count(DISTINCT file) AS sources, count(*) AS chunks, sum({twords}) AS words, sum(length(text) + 1) - 1 AS chars, sum(strlen(text) + 1) - 1 AS bytes "
        "FROM preprocess_text JOIN dataset_files USING (file) WHERE text IS NOT NULL AND family IS NOT NULL GROUP BY family) "
        "SELECT family, CAST(sum(sources) AS BIGINT) AS sources, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(bytes) AS BIGINT) AS bytes FROM ea GROUP BY ROLLUP (family)"
    )
    expr = "text"
    for a, b in rules.PUNCTUATION.items():
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    out["plain_punctuation"] = f"SELECT text_id, {expr} AS text FROM preprocess_text"
    links = sub(sub(sub("text", f"https?://{sql.NS}+|www\\.{sql.NS}+", " ", "i"), f"@{sql.W}+", " "), f"#{sql.W}+", " ")
    out["without_links"] = f"SELECT text_id, {links} AS text FROM preprocess_text"
    out["masked_markers"] = f"SELECT line_id, {sub('text', rules.MARKER, '__U_' + chr(92) + '1__')} AS text FROM clean_raw_dataset_text"
    out["atomic_lengths"] = f"SELECT line_id, CAST(coalesce(len(regexp_extract_all(text, {unit})), 0) AS BIGINT) AS units FROM clean_raw_dataset_text"
    cases = " ".join(f"WHEN regexp_matches(replace(lower(file), '-', '_'), {lit('|'.join(w))}) THEN {lit(t)}" for t, w in rules.NAME_KEYWORDS.items())
    out["typology_names"] = f"SELECT file, CASE {cases} ELSE 'fusional' END AS typology FROM dataset_files"
    blocks = lambda names: f"regexp_matches(t, {lit('|'.join(f'__U_{n}|' + chr(92) + '[U' + chr(92) + f'+{n}' for n in names))})"
    anyof = lambda names: f"list_has_any(regexp_split_to_array(lower(t), {lit(sql.S + '+')}), [{', '.join(map(lit, names))}])"
    out["typology_lines"] = (
        f"SELECT text_id, CASE WHEN {blocks(rules.FUSIONAL_BLOCKS)} OR {anyof(rules.FUSIONAL_WORDS)} THEN 'fusional' WHEN {blocks(rules.ANALYTIC_BLOCKS)} OR {anyof(rules.ANALYTIC_WORDS)} THEN 'analytic' ELSE 'agglutination' END AS typology "
        "FROM (SELECT text_id, coalesce(text, '') AS t FROM preprocess_text)"
    )
    names = out["typology_names"].split(" AS typology")[0].removeprefix("SELECT file, ")
    lines_ = out["typology_lines"].split(" AS typology")[0].removeprefix("SELECT text_id, ")
    out["routed_lines"] = f"SELECT file, CASE WHEN regexp_matches(lower(file), 'all|corpus') THEN {lines_} ELSE {names} END AS typology, count(*) AS n FROM (SELECT file, text AS t FROM preprocess_text WHERE text IS NOT NULL) GROUP BY 1, 2"
    values = ", ".join(f"({lit(f)}, {r}, {lit(a)}, {lit(''.join(c for c in a if c.isascii() and c.isalnum()))})" for r, (f, names) in enumerate(rules.ALIASES.items()) for a in names)
    noise = ", ".join(map(lit, sorted(rules.NAME_NOISE)))
    skip = ", ".join(map(lit, sorted(rules.GENERATED | rules.PASSED_OVER)))
    fam = (
        f"WITH al(family, family_rank, alias, bare) AS (VALUES {values}), f AS (SELECT file, lower(file) AS raw, regexp_replace(lower(file), '\\.[^.]*$', '') AS stem FROM dataset_files WHERE lower(file) NOT IN ({skip})), "
        "tk AS (SELECT file, unnest(regexp_split_to_array(stem, '[^a-z0-9]+')) AS tok FROM f), "
        f"hit AS (SELECT file, 1 AS tier, family_rank, family FROM tk JOIN al ON tok = bare WHERE tok <> '' AND tok NOT IN ({noise}) "
        "UNION ALL SELECT file, CASE WHEN length(bare) >= 3 AND contains(regexp_replace(stem, '[^a-z0-9]', '', 'g'), bare) THEN 2 ELSE 3 END, family_rank, family FROM f JOIN al ON (length(bare) >= 3 AND contains(regexp_replace(stem, '[^a-z0-9]', '', 'g'), bare)) OR (length(alias) >= 3 AND contains(raw, alias))), "
        "best AS (SELECT file, tier, family, row_number() OVER (PARTITION BY file ORDER BY tier, family_rank) AS r FROM hit)"
    )
    out["family_names"] = f"{fam} SELECT d.file, b.family, CAST(b.tier AS INTEGER) AS tier FROM dataset_files d LEFT JOIN best b ON d.file = b.file AND b.r = 1"
    out["family_files"] = f"{fam} SELECT family, string_agg(file, ' ' ORDER BY file) AS files FROM best WHERE r = 1 GROUP BY family"
    out["char_codec"] = (
        "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS tokens, regexp_replace(coalesce(text, ''), '(?s)[^ -~]', ' ', 'g') AS back FROM documents"
    )
    own = f"{sql.clause_ctes('languages')}, sf AS (SELECT unnest({sql.surface_list('clause')}) AS surface FROM cl)"
    return out | coding.oracle_sql(own) | reading.oracle_sql(out["family_names"])

