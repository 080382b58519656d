"""Sentences of cleaned text: split after end marks with their closing marks, keep those with a letter or digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.clean import cleaned
from corpusloom.functions.regexkit import let, strip


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-" else c for c in chars) + "]"


END, CLOSE, DONE = _class(rules.TERMINATORS), _class(rules.CLOSERS), _class(rules.FINISHED)
_PIECE = rf"([^{END[1:]}*)({END}+{CLOSE}*|$)"
#: What ends a line of a text with line breaks in it.
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def finished(text: Column) -> Column:
    """A line without an end mark gets a full stop."""
    return let(text, lambda t: F.when(t.rlike(rf"{DONE}\z"), t).otherwise(F.concat(t, F.lit("."))))


def joined_lines(text: Column) -> Column:
    """Line breaks inside a text: each line stripped, finished and joined by a space."""

    def joined(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, _LINE), strip), lambda x: x != "")
        return F.when(t.rlike(r"[\r\n]"), F.array_join(F.transform(lines, finished), " ")).otherwise(t)

    return let(text, joined)


def sentence_array(text: Column) -> Column:
    """Sentences of one text in order."""
    pieces = F.regexp_extract_all(joined_lines(text), F.lit(_PIECE), F.lit(0))
    parts = F.transform(pieces, lambda p: F.struct(strip(F.regexp_extract(p, _PIECE, 1)).alias("body"), F.regexp_extract(p, _PIECE, 2).alias("mark")))

    def one(p: Column) -> Column:
        return F.when(p["mark"] != "", F.concat(p["body"], p["mark"])).when(p["body"].rlike(rf"{DONE}\z"), p["body"]).otherwise(F.concat(p["body"], F.lit(".")))

    return F.filter(F.transform(F.filter(parts, lambda p: p["body"] != ""), one), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def sentences(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., sent_no, sentence), one row per sentence, numbered from 0."""
    return df.select(*keep, F.posexplode(sentence_array(F.col(text))).alias("sent_no", "sentence"))


def corpus_sentences(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw lines to sentences: clean, drop empty lines, finish, split."""
    lines = df.select(*keep, finished(cleaned(F.col(text))).alias("_clean"))  # an empty line comes to ".", which is no sentence
    return sentences(lines, "_clean", keep)
