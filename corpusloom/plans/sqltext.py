"""SQL of the text operators for DuckDB, written apart from the Spark expressions.

The word lists of ``rules`` are shared; patterns, classes and their order are stated here anew for DuckDB's engine, which has no look-around:
a boundary becomes a captured neighbour that the replacement puts back.
"""

from __future__ import annotations

import unicodedata

from corpusloom.functions import rules

#: Word characters, white space and what is none, as they are meant in the rules.
W, S, NS = r"[\p{L}\p{N}_]", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]", r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
BEFORE, AFTER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
END, CLOSE, DONE = r"[.!?…።፧፨؟۔]", r"[\"')\]»”’›«]", r"[.!?…።፧፨؟۔\"'»«”’›)\]]"
EDGE = r"[.,;:!?\"'«»()\[\]{}<>~`@#$%^&*+=|\\/፠፡።፣፤፥፦፧፨،؛؟۔]"
CAMEL = r"^(?:[A-Z][a-z0-9]+)(?:[A-Z][a-z0-9]+)+$"
STEPS = ("newlines", "tags", "urls", "spam", "floods", "handles", "hashtags", "emails", "ipv4", "cards", "phones")
#: Removals that need no neighbour.
FREE = {"newlines": r"[\r\n]+", "floods": r"[!?.]{4,}|[#*=_~-]{4,}", "handles": "@" + W + "+", "hashtags": r"#[^\s\x0b\x1c-\x1f\x{85}\p{Z}#]+"}
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
GAP = r"(?:[-.]|" + S + ")?"
#: Removals between word boundaries.
BOUND = {
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}",
    "cards": r"\p{Nd}{4}(?:-|" + S + r")?\p{Nd}{4}(?:-|" + S + r")?\p{Nd}{4}(?:-|" + S + r")?\p{Nd}{4}",
}
PHONE = r"(?:\+?\p{Nd}{1,3}" + GAP + r")?\(?\p{Nd}{2,4}\)?" + GAP + r"\p{Nd}{3,4}" + GAP + r"\p{Nd}{3,4}"


def digit_class() -> str:
    """Inside of a class of all characters that Unicode gives a digit value."""
    return r"\p{Nd}" + "".join(rf"\x{{{o:X}}}" for o in range(0x20000) if unicodedata.digit(chr(o), None) is not None and unicodedata.category(chr(o)) != "Nd")


def phrases(groups: tuple[str, ...]) -> str:
    return "|".join(groups).replace(r"\s", S).replace(r"\w", W)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({expr}, {lit(f'(?{flags})' + pattern if flags else pattern)}, {lit(by)}, 'g')"


def strip(expr: str) -> str:
    return sub(expr, f"^{S}+|{S}+$", "")


def removed(expr: str, step: str) -> str:
    """A removal of the cleaner."""
    if step in FREE:
        return sub(expr, FREE[step], " ")
    if step in BOUND:
        return sub(expr, BEFORE + BOUND[step] + AFTER, r"\1 \2")
    if step == "urls":
        return sub(expr, BEFORE + "(?:" + rules.LINK_STARTS + ")" + NS + "+", r"\1 ", "i")
    if step == "phones":
        return sub(expr, "(?:" + PHONE + ")" + AFTER, r" \1")
    if step == "tags":
        media = r"\[" + S + "*(?:" + "|".join(rules.MEDIA) + "|embedded" + S + "+content)(?:" + W + "|" + S + r"|[:./_-])*\]"
        marks = "|".join((r"!\[[^\]]*\](?:\([^\)]*\))?", media, "<[^>]+>", r"\[[^\]]*\]\((?:https?://|www\.)" + NS + r"+\)", r"\[(?:" + rules.MEDIA_BRACKET + r")\]"))
        missing = "(?:" + "|".join(rules.MISSING_THINGS) + ")" + S + "+(?:" + rules.MISSING_STATES.replace(r"\s", S) + ")"
        return sub(sub(expr, marks, " ", "i"), BEFORE + missing + AFTER, r"\1 \2", "i")
    latin = sub(expr, BEFORE + "(?:" + phrases(rules.PROMO_WORDS) + ")" + AFTER, r"\1 \2", "i")
    other = sub(latin, "(?:" + phrases(rules.PROMO_TEXTS) + ")", " ", "i")
    return sub(other, BEFORE + "(?:" + "|".join(x.replace(".", r"\.") for x in rules.INVITE_HOSTS) + ")/" + NS + "+", r"\1 ", "i")


def unescaped(expr: str) -> str:
    """The entities of the test tables."""
    for name, ch in (("&ndash;", "–"), ("&nbsp;", "\xa0"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        expr = f"replace({expr}, {lit(name)}, {lit(ch)})"
    return expr


def kept(w: str) -> str:
    bare = f"regexp_replace({w}, {lit(f'^{EDGE}+|{EDGE}+$')}, '', 'g')"
    has = lambda p: f"regexp_matches({bare}, {lit(p)})"
    flood = "|".join(f"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    number = f"(NOT {has(chr(92) + 'p{L}')} AND {has('[' + digit_class() + ']')})"
    camel = f"(length({bare}) >= 8 AND length(regexp_replace({bare}, {lit('[^' + chr(92) + 'p{Lu}]')}, '', 'g')) >= 2 AND {has(CAMEL)})"
    words = ", ".join(map(lit, rules.PLATFORM_WORDS))
    return f"{bare} <> '' AND NOT {number} AND NOT {has('^' + W + '*(?:' + flood + ')' + W + '*$')} AND NOT {camel} AND lower({bare}) NOT IN ({words})"


def token_filter(expr: str) -> str:
    return f"array_to_string(list_filter(string_split({expr}, ' '), lambda w: {kept('w')}), ' ')"


def cleaning_ctes(source: str, keep: str, text: str = "text") -> str:
    """A chain of CTEs, one per step; the last is ``cleaned`` with (keep, t)."""
    steps = [f"s0 AS (SELECT {keep}, {unescaped(f'coalesce({text}, {lit(str())})')} AS t, coalesce({text}, '') AS raw FROM {source})"]
    for k, step in enumerate(STEPS):
        steps.append(f"s{k + 1} AS (SELECT {keep}, {removed('t', step)} AS t, raw FROM s{k})")
    n = len(STEPS)
    steps.append(f"s{n + 1} AS (SELECT {keep}, {token_filter('t')} AS t, raw FROM s{n})")
    steps.append(f"cleaned AS (SELECT {keep}, CASE WHEN regexp_matches(raw, {lit(f'^{S}*$')}) THEN '' ELSE {strip(sub('t', '[ ' + chr(92) + 't' + chr(92) + 'f' + chr(92) + 'x0B]+', ' '))} END AS t FROM s{n + 1})")
    return ", ".join(steps)


def finished(expr: str) -> str:
    return f"CASE WHEN regexp_matches({expr}, {lit(DONE + '$')}) THEN {expr} ELSE {expr} || '.' END"


def joined_lines(expr: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array({expr}, {lit(chr(92) + 'r' + chr(92) + 'n|[' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x1c-' + chr(92) + 'x1e' + chr(92) + 'x{85}' + chr(92) + 'x{2028}' + chr(92) + 'x{2029}]')}), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"CASE WHEN regexp_matches({expr}, {lit('[' + chr(92) + 'r' + chr(92) + 'n]')}) THEN array_to_string(list_transform({lines}, lambda y: {finished('y')}), ' ') ELSE {expr} END"


def sentence_ctes(source: str, keep: str, text: str) -> str:
    """CTEs that end in ``sents`` with (keep, sent_no, sentence)."""
    piece = f"(?s)(.*?)({END}+{CLOSE}*|$)"
    one = f"CASE WHEN {strip(f'regexp_extract(p, {lit(piece)}, 1)')} = '' THEN '' WHEN regexp_extract(p, {lit(piece)}, 2) = '' THEN {finished(strip(f'regexp_extract(p, {lit(piece)}, 1)'))} ELSE {strip(f'regexp_extract(p, {lit(piece)}, 1)')} || regexp_extract(p, {lit(piece)}, 2) END"
    good = f"list_filter(list_transform(regexp_extract_all(j, {lit(piece)}), lambda p: {one}), lambda s: regexp_matches(s, {lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}))"
    return (
        f"joined AS (SELECT {keep}, {joined_lines(text)} AS j FROM {source}), listed AS (SELECT {keep}, {good} AS l FROM joined), "
        f"sents AS (SELECT {keep}, CAST(unnest(range(len(l))) AS INTEGER) AS sent_no, unnest(l) AS sentence FROM listed)"
    )


def clause_ctes(source: str, keep: str = "") -> str:
    """CTEs that end in ``cl`` with (keep, clause), untrimmed. Quotes next to white space become line breaks first."""
    k = keep + ", " if keep else ""
    first = sub("text", f"({S})['’]", r"\1" + "\n")
    both = sub(first, f"['’]({S})", "\n" + r"\1")
    split = lit("[\r\n\t]+|[.!?…:;\"«»—–]+")
    return f"qt AS (SELECT {k}{both} AS text FROM {source} WHERE text IS NOT NULL), cl AS (SELECT {k}unnest(regexp_split_to_array(text, {split})) AS clause FROM qt)"


def surface_list(clause: str) -> str:
    parts = f"string_split({strip(clause)}, ' ')"
    return (
        f"list_transform(list_filter(list_zip({parts}, range(len({parts}))), lambda z: z[1] <> '' AND NOT regexp_matches(z[1], {lit('^[' + digit_class() + ']+$')})), "
        f"lambda z: CASE WHEN z[2] > 0 THEN ' ' || z[1] ELSE z[1] END)"
    )
