"""Queries of the normaliser, the coder and the segmenter with fixed vocabularies, and SQL for them written apart from the operators.

In SQL a text is a table of its characters: one table of compatibility forms and one of markers, both built from Unicode's own data, are joined to
them. The fewest tokens come from a recursive walk from a text's end to its start over the tokens that match at each place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import normalize as nz
from corpusloom.functions import rules
from corpusloom.operators import classify, codec, counts, evaluate, sampling
from corpusloom.plans.sqltext import NS, S, W, lit, sub, strip
from corpusloom.runtime import spread, table

#: A vocabulary with long tokens, tokens inside others, and ties between ways of equal length.
LONG = (
    "th", "he", "the", "an", "na", "ana", "and", "wa", "ki", "kwa", "ni", "in", "ng", "ing", "er", "re", "ere", "at", "ta", "ata", " a", " t", "a ", "e ", " the", "the ", "[U+", "U+1", "LATIN SMALL LETTER ", "SMALL ", "LETTER", "LETTER E", "TTER", "WITH ", "ETHIOPIC SYLLABLE ", "SYLL", "ABLE ",
    "ARABIC LETTER ", "C LET", "0301", "DOT BELOW]", "ACUTE]", "W]", "]", "aa", "aaa", "ab", "ba", "aba", "bab",
)
VOCABULARY = {chr(c): i for i, c in enumerate(rules.ASCII)} | {t: len(rules.ASCII) + i for i, t in enumerate(t for t in LONG if len(t) > 1)}
RATIO = 0.3


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "languages").select("sent_id", "file", "text"))


def fixed_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the fewest tokens and the decoded text, over raw texts; characters beyond the vocabulary become token 0."""
    rows = _languages(spark, sf_dir).select("sent_id", codec.encoder(VOCABULARY)(F.coalesce("text", F.lit(""))).alias("ids"))
    return codec.decoded(rows, VOCABULARY, to="back").select("sent_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "back")


def fixed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each normalised text comes back, and its number of tokens."""
    back = evaluate.encoded_corpus(_languages(spark, sf_dir), VOCABULARY, keep=("sent_id",))
    return back.select("sent_id", (F.col("text") == F.col("back")).alias("exact"), F.size("ids").alias("tokens"))


def fixed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression and round-trip report by file and over all."""
    return evaluate.report(_languages(spark, sf_dir), VOCABULARY)


def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each distinct word surface after the leftmost merges into a fixed vocabulary."""
    words = counts.word_counts(_languages(spark, sf_dir).where("text IS NOT NULL")).select(F.array("surface").alias("words"), F.col("n"))
    known = set(VOCABULARY)
    cut = codec.segmented(words, known)
    return cut.select(F.array_join("units", "|").alias("units"), "n")


def unmasked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the masked corpus with their stand-ins turned back into markers."""
    marked = table(spark, sf_dir, "preprocess_text").select(nz.normalised(F.col("text")).alias("text"))
    words = marked.select(F.explode(F.split(nz.masked(F.col("text")), " ")).alias("token")).where("token <> ''").distinct()
    return nz.unmask_tokens(words, nz.marker_dictionary(marked, "text")).select(F.col("token").alias("word"))


def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataset_files").select("file", nz.file_key(F.col("file")).alias("key"))


def routed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of lines of each file that go to each typology."""
    return classify.routed(table(spark, sf_dir, "preprocess_text").where("text IS NOT NULL").select("file", "text")).groupBy("file", "typology").agg(F.count("*").alias("n"))


def subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows with the smallest draw keys."""
    return sampling.subsample(table(spark, sf_dir, "languages").select("sent_id"), ("sent_id",), RATIO)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (fixed_codec, fixed_roundtrip, fixed_report, segmented_words, unmasked_words, file_keys, routed_lines, subsampled)
    return {f.__name__: f for f in own}


#: Blocks of Unicode whose characters the SQL knows; another character would stay as it is and show as a difference.
BLOCKS = ((0x80, 0x800), (0x900, 0x980), (0x1200, 0x1400), (0x1800, 0x18B0), (0x1C80, 0x1C90), (0x1D00, 0x2150), (0x2460, 0x2500), (0x2C60, 0x2C80), (0x2D80, 0x2DE0), (0x3000, 0x3001), (0xA4D0, 0xA500), (0xA640, 0xA6A0), (0xA720, 0xA800), (0xAB00, 0xABC0), (0xFB00, 0xFB07), (0xFB50, 0xFE00), (0xFE00, 0xFF00), (0xFF00, 0xFFEF), (0xFFFD, 0xFFFE), (0x1F300, 0x1F6D0), (0x1D400, 0x1D800))


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"({lit(a)}, {lit(b)})" for a, b in rows)


def _chars() -> list[str]:
    return [chr(o) for a, b in BLOCKS for o in range(a, b) if unicodedata.category(chr(o)) not in ("Cn", "Cs")]


def normal_ctes(source: str, key: str) -> str:
    """CTEs that end in ``composed`` and ``normal`` with (key, t): the text after composition and punctuation, and with markers."""
    forms = [(c, unicodedata.normalize("NFKC", c)) for c in _chars() if unicodedata.normalize("NFKC", c) != c]
    marks = [(c, rules.PUNCTUATION[c] if c in rules.PUNCTUATION else f"[U+{ord(c):04X} {unicodedata.name(c, 'UNKNOWN')}]") for c in _chars()]
    links = sub(sub(sub("coalesce(text, '')", f"https?://{NS}+|www\\.{NS}+", " ", "i"), f"@{W}+", " "), f"#{W}+", " ")
    each = lambda t: f"unnest(regexp_extract_all({t}, '(?s).')) AS c, unnest(range(len(regexp_extract_all({t}, '(?s).')))) AS i"
    squeezed = strip(sub("t", f"{S}+", " "))
    return (
        f"forms(c, r) AS (VALUES {_values(forms)}), marks(c, r) AS (VALUES {_values(marks)}), "
        f"unlinked AS (SELECT {key}, {links} AS t FROM {source}), c1 AS (SELECT {key}, {each('t')} FROM unlinked), "
        f"t1 AS (SELECT {key}, nfc_normalize(string_agg(coalesce(forms.r, c1.c), '' ORDER BY i)) AS t FROM c1 LEFT JOIN forms ON c1.c = forms.c GROUP BY {key}), "
        f"c2 AS (SELECT {key}, {each('t')} FROM t1), t2 AS (SELECT {key}, string_agg(coalesce(marks.r, c2.c), '' ORDER BY i) AS t FROM c2 LEFT JOIN marks ON c2.c = marks.c GROUP BY {key}), "
        f"composed AS (SELECT {key}, {squeezed} AS t FROM (SELECT {key}, string_agg(CASE WHEN ord(c2.c) > 126 AND left(marks.r, 3) = '[U+' THEN c2.c ELSE coalesce(marks.r, c2.c) END, '' ORDER BY i) AS t FROM c2 LEFT JOIN marks ON c2.c = marks.c GROUP BY {key})), "
        f"normal AS MATERIALIZED (SELECT u.{key}, coalesce({squeezed.replace(', t,', ', t2.t,').replace('(t,', '(t2.t,')}, '') AS t FROM unlinked u LEFT JOIN t2 ON u.{key} = t2.{key})"
    )


def token_ctes(source: str, key: str) -> str:
    """CTEs that end in ``walk`` with (key, p, token, step) of the tokens taken, from (key, t) of ``source``; and ``best`` with every place's choice.

    ``costs[k]`` is the cost of the text from k characters further on. One character costs a token; a longer token wins if it is
    cheaper, the shortest of the cheapest.
    """
    longest = max(map(len, VOCABULARY))
    long = ", ".join(f"({lit(t)}, {i}, {len(t)})" for t, i in VOCABULARY.items() if len(t) > 1)
    single = ", ".join(f"({lit(t)}, {i})" for t, i in VOCABULARY.items() if len(t) == 1)
    return (
        f"v(tok, id, n) AS (VALUES {long}), one(tok, id) AS (VALUES {single}), sizes AS (SELECT DISTINCT n FROM v), "
        f"place AS MATERIALIZED (SELECT {key}, t, unnest(range(1, length(t) + 1)) AS p FROM {source} WHERE t <> ''), "
        f"hit AS MATERIALIZED (SELECT {key}, p, list({{'n': v.n, 'id': v.id}}) AS ways FROM place, sizes JOIN v ON v.n = sizes.n AND v.tok = substr(t, p, v.n) WHERE p + sizes.n - 1 <= length(t) GROUP BY {key}, p), "
        f"char AS MATERIALIZED (SELECT place.{key}, place.p, coalesce(one.id, 0) AS id, coalesce(ways, []) AS ways FROM place LEFT JOIN one ON one.tok = substr(t, place.p, 1) LEFT JOIN hit ON hit.{key} = place.{key} AND hit.p = place.p), "
        f"best AS MATERIALIZED (SELECT {key}, CAST(length(t) + 1 AS BIGINT) AS p, 0 AS token, 0 AS step, list_prepend(0, list_transform(range({longest}), lambda x: 1000000)) AS costs FROM {source} WHERE t <> '' "
        f"UNION ALL SELECT b.{key}, b.p - 1, CASE WHEN w.cost < b.costs[1] + 1 THEN w.id ELSE w.single END, CASE WHEN w.cost < b.costs[1] + 1 THEN w.n ELSE 1 END, list_prepend(least(coalesce(w.cost, 1000000), b.costs[1] + 1), b.costs[1:{longest}]) "
        f"FROM best b JOIN (SELECT {key}, p, id AS single, ways FROM char) c ON c.{key} = b.{key} AND c.p = b.p - 1, "
        "LATERAL (SELECT c.single AS single, list_min(list_transform(c.ways, lambda x: {'cost': b.costs[x.n] + 1, 'n': x.n, 'id': x.id})) AS m) l, "
        "LATERAL (SELECT l.single AS single, l.m.cost AS cost, l.m.n AS n, l.m.id AS id) w), "
        f"walk AS (SELECT {key}, p, token, step FROM best WHERE p = 1 AND step > 0 UNION ALL SELECT b.{key}, b.p, b.token, b.step FROM walk JOIN best b ON b.{key} = walk.{key} AND b.p = walk.p + walk.step WHERE b.step > 0)"
    )


def oracle_sql(surfaces: str) -> dict[str, str]:
    """``surfaces``: CTEs that end in ``sf`` with the word surfaces of the table languages."""
    out: dict[str, str] = {}
    lines = f"WITH {normal_ctes('preprocess_text', 'text_id')}"
    out["normalised_lines"] = f"{lines} SELECT text_id, t AS text FROM normal"
    masked = sub("t", rules.MARKER, "__U_" + chr(92) + "1__")
    out["marker_freq"] = f"{lines}, m AS (SELECT unnest(regexp_extract_all({masked}, {lit(rules.PLACEHOLDER)})) AS placeholder FROM normal) SELECT placeholder, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= {rules.LEAST_MARKER}"
    out["unmasked_words"] = (
        f"{lines}, w AS (SELECT DISTINCT unnest(string_split(t, ' ')) AS word FROM composed), c AS (SELECT word, unnest(regexp_extract_all(word, '(?s).')) AS c, unnest(range(len(regexp_extract_all(word, '(?s).')))) AS i FROM w WHERE word <> '') "
        "SELECT string_agg(coalesce(marks.r, c.c), '' ORDER BY i) AS word FROM c LEFT JOIN marks ON c.c = marks.c GROUP BY c.word"
    )
    back = " ".join(f"WHEN {i} THEN {lit(t)}" for t, i in VOCABULARY.items())
    raw = "raw AS (SELECT sent_id, coalesce(text, '') AS t FROM languages)"
    out["fixed_codec"] = (
        f"WITH RECURSIVE {raw}, {token_ctes('raw', 'sent_id')}, done AS (SELECT sent_id, string_agg(token, ' ' ORDER BY p) AS ids, string_agg(CASE token {back} END, '' ORDER BY p) AS back FROM walk GROUP BY sent_id) "
        "SELECT r.sent_id, coalesce(ids, '') AS ids, coalesce(back, '') AS back FROM raw r LEFT JOIN done ON r.sent_id = done.sent_id"
    )
    coded = (
        f"WITH RECURSIVE {normal_ctes('languages', 'sent_id')}, src AS (SELECT sent_id, t FROM normal WHERE t <> ''), {token_ctes('src', 'sent_id')}, "
        f"done AS (SELECT sent_id, CAST(count(*) AS INTEGER) AS tokens, string_agg(CASE token {back} END, '' ORDER BY p) AS back FROM walk GROUP BY sent_id)"
    )
    out["fixed_roundtrip"] = f"{coded} SELECT sent_id, t = back AS exact, tokens FROM src JOIN done USING (sent_id)"
    unit = lambda t: f"len(regexp_extract_all({t}, {lit(rules.UNIT)}))"
    words = f"len(regexp_extract_all(t, {lit(NS + '+')}))"
    out["fixed_report"] = (
        f"{coded}, e AS (SELECT file, t, back, tokens FROM src JOIN done USING (sent_id) JOIN languages USING (sent_id)), "
        f"s AS (SELECT file, count(*) AS sentences, CAST(sum({words}) AS BIGINT) AS words, CAST(sum({unit('t')}) AS BIGINT) AS chars_in, CAST(sum({unit('back')}) AS BIGINT) AS chars_out, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CAST(t = back AS BIGINT)) AS BIGINT) AS exact FROM e GROUP BY ROLLUP (file)) "
        "SELECT *, round(chars_in / greatest(1, tokens), 6) AS chars_per_token, round(words / greatest(1, tokens), 6) AS words_per_token, exact = sentences AND chars_in = chars_out AS passed FROM s"
    )
    known = "[" + ", ".join(lit(t) for t in VOCABULARY if len(t) > 1) + "]"
    out["segmented_words"] = (
        f"WITH RECURSIVE {surfaces}, w AS (SELECT surface, count(*) AS n FROM sf GROUP BY surface), "
        f"st AS (SELECT surface, regexp_extract_all(surface, {lit(rules.UNIT)}) AS l, 1 AS more FROM w UNION ALL "
        "SELECT surface, list_concat(list_concat(l[1:k - 1], [l[k] || l[k + 1]]), l[k + 2:]), 1 FROM (SELECT surface, l, "
        f"list_position(list_transform(range(1, len(l)), lambda i: list_contains({known}, l[i] || l[i + 1])), true) AS k FROM st) q WHERE k > 0), "
        "last AS (SELECT surface, l FROM st QUALIFY row_number() OVER (PARTITION BY surface ORDER BY len(l)) = 1) SELECT array_to_string(l, '|') AS units, n FROM last JOIN w USING (surface)"
    )
    suffixes = "_dataset|_cln|_cleaned|_clean|_train|_eval|_test|_corpus|_text|_webtext|_mix|_raw|_data|_final|_v[0-9]+"
    stem = "regexp_replace(file, '\\.[^.]*$', '')"
    out["file_keys"] = f"SELECT file, lower(regexp_replace(regexp_replace(regexp_replace({stem}, '({suffixes})$', '', 'i'), '(_normalized|_norm)$', '', 'i'), '[^A-Za-z0-9]', '', 'g')) AS key FROM dataset_files"
    out["subsampled"] = f"SELECT sent_id FROM languages ORDER BY md5('{rules.SEED}|' || CAST(sent_id AS VARCHAR)) LIMIT (SELECT CAST(floor(count(*) * {RATIO}) AS BIGINT) FROM languages)"
    return out
