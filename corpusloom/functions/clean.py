"""The cleaner: ordered removals on a text column, each a single JVM expression.

Every removal leaves one space. Null and blank texts come out as "". The order is part of the
result: tags before links, handles before e-mail addresses.
"""

from __future__ import annotations

import html

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import rules
from corpusloom.functions.regexkit import S, W, classes, digit_class, java, replace_all, strip
from corpusloom.runtime import valid


def phrases(groups: tuple[str, ...]) -> str:
    """Alternation of a phrase table."""
    return classes("|".join(groups))


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def by_first_letter(pattern: str) -> str:
    """The same alternation grouped by literal first letters, so that an engine that tries one branch after another skips most of them.

    Branches with different first letters never match at one place, and the order inside a letter stays.
    """
    groups: dict[str, list[str]] = {}
    rest: list[str] = []
    for a in alternatives(pattern):
        if a[0].isalpha() and not (len(a) > 1 and a[1] in "?*+{"):
            groups.setdefault(a[0], []).append(a[1:])
        else:
            rest.append(a)
    return "|".join([f"{c}(?:{'|'.join(v)})" for c, v in groups.items()] + rest)


#: Start of a word, before a pattern that begins with a word character.
START = rf"(?<!{W})"


# The patterns of the removals, in order.
PATTERNS = {
    "newlines": (r"[\r\n]+", ""),
    "tags": (
        r"!\[[^\]]*\](?:\([^\)]*\))?"
        r"|\[{S}*(?:" + "|".join(rules.MEDIA) + r"|embedded{S}+content)(?:{W}|{S}|[:./_-])*\]"
        r"|<[^>]+>"
        r"|\[[^\]]*\]\((?:https?://|www\.){NS}+\)"
        r"|\[(?:" + rules.MEDIA_BRACKET + r")\]"
        r"|{B}(?:" + "|".join(rules.MISSING_THINGS) + r"){S}+(?:" + classes(rules.MISSING_STATES) + r"){B}",
        "iu",
    ),
    "urls": (r"{B}(?:" + rules.LINK_STARTS + r"){NS}+", "iu"),
    "spam": (
        r"{B}(?:" + phrases(rules.PROMO_WORDS) + r"){B}|" + phrases(rules.PROMO_TEXTS) + r"|{B}(?:" + "|".join(x.replace(".", r"\.") for x in rules.INVITE_HOSTS) + r")/{NS}+",
        "iu",
    ),
    "floods": (r"[!?.]{4,}|[#*=_~-]{4,}", ""),
    "handles": (r"@{W}+", ""),
    "hashtags": (r"#[^\s\x1c-\x1f\x85\p{Z}#]+", ""),
    "emails": (r"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}{B}", ""),
    "ipv4": (r"{B}(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?){B}", ""),
    "cards": (r"{B}(?:\p{Nd}{4}(?:-|{S})?){3}\p{Nd}{4}{B}", ""),
    "phones": (r"(?:\+?\p{Nd}{1,3}(?:[-.]|{S})?)?\(?\p{Nd}{2,4}\)?(?:[-.]|{S})?\p{Nd}{3,4}(?:[-.]|{S})?\p{Nd}{3,4}{B}", ""),
}
ORDER = tuple(PATTERNS)

#: The same patterns in a form that Java's engine runs faster: every branch after a boundary begins with a word character.
_FASTER = {
    "spam": (
        START + "(?:" + by_first_letter(phrases(rules.PROMO_WORDS)) + "){B}|(?:" + by_first_letter(phrases(rules.PROMO_TEXTS)) + ")|" + START + "(?:" + "|".join(x.replace(".", r"\.") for x in rules.INVITE_HOSTS) + ")/{NS}+",
        "iu",
    ),
    **{k: (START + PATTERNS[k][0].removeprefix("{B}"), PATTERNS[k][1]) for k in ("urls", "ipv4", "cards")},
}


def removed(text: Column, step: str) -> Column:
    """One removal by its name."""
    pattern, flags = _FASTER.get(step) or PATTERNS[step]
    return replace_all(text, pattern, " ", flags)


def unescaped(text: Column | str) -> Column:
    """HTML entities decoded; only texts with an ampersand are touched."""
    return _unescaped(valid(text))


@F.arrow_udf(StringType())
def _unescaped(col: pa.Array) -> pa.Array:
    has = pc.fill_null(pc.match_substring(col, "&"), False)
    if not pc.any(has).as_py():
        return col
    return pa.array([html.unescape(t) if h else t for t, h in zip(col.to_pylist(), has.to_pylist())], pa.string())


_EDGE = "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in rules.TOKEN_EDGE) + "]"


def has_letter_and_digit(token: Column) -> Column:
    """Mixed words such as Arabizi or product names."""
    return token.rlike(r"\p{L}") & token.rlike(f"[{digit_class()}]")


def bare_token(token: Column) -> Column:
    """A token without the punctuation around it."""
    return F.regexp_replace(token, F.lit(f"^{_EDGE}+|{_EDGE}+$"), F.lit(""))


def keeps(bare: Column) -> Column:
    """Whether the token filter keeps a token, judged by its bare form."""
    number = ~bare.rlike(r"\p{L}") & bare.rlike(f"[{digit_class()}]")
    camel = (F.length(bare) >= 8) & (F.length(F.regexp_replace(bare, F.lit(r"[^\p{Lu}]"), F.lit(""))) >= 2) & bare.rlike(rules.CAMEL)
    return (bare != "") & ~number & ~bare.rlike(java(classes(rules.FLOOD))) & ~camel & ~F.lower(bare).isin(*rules.PLATFORM_WORDS)


def token_filter(text: Column) -> Column:
    """Tokens between single spaces, without numbers, floods, campaign compounds and platform words."""
    pairs = F.transform(F.split(text, " "), lambda w: F.struct(w.alias("w"), bare_token(w).alias("b")))
    return F.array_join(F.transform(F.filter(pairs, lambda p: keeps(p["b"])), lambda p: p["w"]), " ")


def cleaned(text: Column) -> Column:
    """The whole cleaner."""
    t = unescaped(F.coalesce(text, F.lit("")))
    for step in ORDER:
        t = removed(t, step)
    t = strip(F.regexp_replace(token_filter(t), F.lit(r"[ \t\f\x0B]+"), F.lit(" ")))
    return F.when(F.coalesce(text, F.lit("")).rlike(f"^{S}*$"), "").otherwise(t)
