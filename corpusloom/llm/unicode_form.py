"""Problem 1: one form for text that looks the same.

Arrow text becomes one numpy array of code points. A lookup table gives each code point the place and
length of its expansion: nothing (invisible characters), one space (any space), the plain letter
(full-width forms, ligatures, look-alike letters) or base letter and marks. Gathers and running
offsets expand the whole batch, a stable sort orders the marks, and rounds of vector look-ups compose
them again. No Python string call is made for a row.

Defined cases: null stays null; empty stays empty; a blank text becomes as many spaces as it has
space characters; texts of any length are worked on in slices; equal texts get equal forms. Letter
case, visible accents, quotation marks and all other visible marks stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.llm.codepoints import pack, rows_of, slices, unpack
from corpusloom.runtime import heavy_keys, join_on_skewed_key, materialise, valid

# Letters of other scripts that are drawn like a Latin letter (after decomposition).
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԁ": "d", "Ԑ": "Ɛ",
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l", "Ӏ": "I", "ԑ": "ɛ", "ә": "ə", "Ә": "Ə", "ө": "ɵ", "Ө": "Ɵ", "ѡ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ͻ": "Ɔ", "ͻ": "ɔ", "ͼ": "c", "ε": "ɛ", "ν": "v", "ο": "o", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U", "ա": "w",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U", "ꓛ": "Ɔ",
    # forms of Latin letters and signs
    "ɡ": "g", "ɑ": "a", "ı": "i", "ℓ": "l", "ⅼ": "l", "ⅰ": "i", "ǃ": "!", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "‐": "-", "‑": "-", "−": "-", "˗": "-", "﹘": "-", "ʼ": "’",
}

# Arabic letters that are drawn alike at the start or inside a word (first value) and at its end (second; the letter itself where they differ there).
JOINED_ALIKE = {"ی": ("ي", "ى"), "ک": ("ك", "ک"), "ہ": ("ه", "ه"), "ھ": ("ه", "ه")}

# Decomposition tags whose forms look like the plain characters. Superscripts, fractions and circled forms don't.
SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"}


def _expand(ch: str) -> str:
    """Full expansion of one character."""
    o = ord(ch)
    cat = unicodedata.category(ch)
    if ch in "\t\n\r\x0b\x0c\x85" or cat in ("Zl", "Zp") or cat == "Zs":
        return " "
    if cat == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F) or o == 0x34F or 0xFE00 <= o <= 0xFE0F or o in (0x115F, 0x1160, 0x3164, 0xFFA0) or 0xE0100 <= o <= 0xE01EF:
        return ""
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    parts = d.split(" ")
    if parts[0][0] == "<":
        tag = parts.pop(0)
        if tag not in SAME_LOOK_TAGS or (parts[0] == "0020" and len(parts) > 1):
            return ch
    return "".join(_expand(chr(int(p, 16))) for p in parts)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, ...]:
    """Expansion start, length and contents, combining class by code point, sorted composition keys and their results."""
    top = 0x110000
    start, length = np.zeros(top, np.int32), np.ones(top, np.int8)
    contents: list[int] = list(range(top))
    start[:] = np.arange(top)
    ccc = np.zeros(top, np.uint8)
    pairs: dict[int, int] = {}
    for o in range(min(top, sys.maxunicode + 1)):
        if 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xD800 <= o < 0xF900 or 0x17000 <= o < 0x1B000 or 0x20000 <= o < 0x2F800 or 0x2FA20 <= o < 0xE0000 or o >= 0xE0200:
            continue
        ch = chr(o)
        ccc[o] = unicodedata.combining(ch)
        e = _expand(ch)
        if e != ch:
            start[o], length[o] = len(contents), len(e)
            contents.extend(map(ord, e))
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split(" "))
            pairs[a << 21 | b] = o
    keys = np.array(sorted(pairs), dtype=np.int64)
    return start, length, np.array(contents, dtype=np.int32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)


def _pair(a: np.ndarray, b: np.ndarray, keys: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Composite of each pair, or -1; Hangul by its arithmetic."""
    k = a << 21 | b
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    out = np.where(keys[at] == k, made[at], -1)
    lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, out)
    lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(lvt, a + (b - 0x11A7), out)


def compose(cps: np.ndarray, row: np.ndarray, ccc_of: np.ndarray, keys: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition within rows."""
    if not len(cps):
        return cps, row
    ccc = ccc_of[cps].astype(np.int64)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    seg = np.cumsum((ccc == 0) | first) - 1
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (seg[1:] == seg[:-1])).any():
        order = np.lexsort((ccc, seg))
        cps, ccc = cps[order], ccc[order]
    cps, keep = cps.copy(), np.ones(len(cps), bool)
    head = np.flatnonzero((ccc == 0) | first)  # the starter of each segment
    end = np.append(head[1:], len(cps))
    open_ = np.flatnonzero((end - head > 1) & (ccc[head] == 0))
    last = np.zeros(len(head), np.int64)  # class of the last mark that stayed
    at = head + 1
    while len(open_):
        s, m = head[open_], at[open_]
        c = _pair(cps[s], cps[m], keys, made)
        ok = (c >= 0) & (last[open_] < ccc[m])
        cps[s[ok]] = c[ok]
        keep[m[ok]] = False
        last[open_[~ok]] = ccc[m[~ok]]
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    cps, row, ccc = cps[keep], row[keep], ccc[keep]
    while len(cps) > 1:  # starter and starter: Hangul and a few Indic vowels
        a, b = cps[:-1], cps[1:]
        maybe = (ccc[:-1] == 0) & (ccc[1:] == 0) & (row[1:] == row[:-1]) & (b >= 0x9BE) & ((b < 0x11C3) | (b >= 0x110BA))
        where = np.flatnonzero(maybe)
        if not len(where):
            break
        c = _pair(a[where], b[where], keys, made)
        where, c = where[c >= 0], c[c >= 0]
        if len(where):  # leftmost of touching pairs first
            free = np.concatenate([[True], np.diff(where) > 1])
            where, c = where[free], c[free]
        if not len(where):
            break
        cps = cps.copy()
        cps[where] = c
        keep = np.ones(len(cps), bool)
        keep[where + 1] = False
        cps, row, ccc = cps[keep], row[keep], ccc[keep]
    return cps, row


def _joined_alike(cps: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Arabic letters that look the same where they stand: whether a letter follows, marks aside, decides."""
    if not ((cps >= 0x6A9) & (cps <= 0x6CC)).any():
        return cps
    cps = cps.copy()
    base = np.flatnonzero(ccc[cps] == 0)
    after = np.append(base[1:], 0)
    same_row = np.append(row[base[1:]] == row[base[:-1]], False)
    follows = same_row & (((cps[after] >= 0x620) & (cps[after] <= 0x64A)) | ((cps[after] >= 0x66E) & (cps[after] <= 0x6D3)))
    own = cps[base].copy()
    for letter, (inside, at_end) in JOINED_ALIKE.items():
        cps[base[(own == ord(letter)) & follows]] = ord(inside)
        cps[base[(own == ord(letter)) & ~follows]] = ord(at_end)
    return cps


def form_of_array(col: pa.Array) -> pa.Array:
    """The consistent form of each text of an Arrow array."""
    start, length, contents, ccc, keys, made = tables()
    out = []
    for at, n in slices(col):
        part = col.slice(at, n)
        null = np.asarray(part.is_null())
        cps, bounds = unpack(part)
        row = rows_of(bounds)
        times = length[cps].astype(np.int64)
        to = np.cumsum(times) - times
        big = contents[np.repeat(start[cps] - to, times) + np.arange(int(times.sum()))].astype(np.int64)
        big = _joined_alike(big, np.repeat(row, times), ccc)
        big, row = compose(big, np.repeat(row, times), ccc, keys, made)
        out.append(pack(big, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64), null))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _form(col: pa.Array) -> pa.Array:
    return form_of_array(col)


def consistent_form(col: Column | str) -> Column:
    """Column of the consistent form."""
    return _form(valid(col))


def look_alikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, string_id, links) of every row whose text looks like a different string of another row.

    Rows of one ``class_id`` look the same, those of one ``string_id`` are the same string (both: the smallest id among
    them), and ``links`` counts the rows of the class with another string. Null and blank texts have nothing to look at
    and are left out. Only digests are shuffled; strings are counted on the map side before anything meets by form, and a
    string that holds a third of all rows is salted.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("s")).where(F.col("s").rlike(r"\S"))
    rows = rows.select("id", "s", consistent_form("s").alias("form"))
    rows = materialise(rows.where(F.trim("form") != "").select("id", F.md5("s").alias("s"), F.md5("form").alias("form")), "forms")
    strings = rows.groupBy("form", "s").agg(F.count("*").alias("n"), F.min("id").alias("string_id"))
    mixed = strings.groupBy("form").agg(F.count("*").alias("kinds"), F.sum("n").alias("whole"), F.min("string_id").alias("class_id")).where("kinds > 1")
    known = materialise(strings.join(mixed, "form").select("s", "n", "string_id", "class_id", (F.col("whole") - F.col("n")).alias("links")), "strings")
    heavy = heavy_keys(known, "s", "n")
    return join_on_skewed_key(rows.select("id", "s"), known.drop("n"), "s", heavy).select("id", "class_id", "string_id", "links")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): rows with the same consistent form and different strings, a < b: the classes of ``look_alikes``, expanded.

    Pairs are made of strings first, then each string's rows are joined to its side, salted where there are many.
    """
    rows = materialise(look_alikes(df, id_col, text_col), "look-alikes")
    strings = rows.groupBy("class_id", "string_id").agg(F.count("*").alias("n"))
    heavy = heavy_keys(strings, "string_id", "n")
    left, right = strings.select("class_id", F.col("string_id").alias("sa")), strings.select("class_id", F.col("string_id").alias("sb"))
    pairs = left.join(right, "class_id").where(F.col("sa") < F.col("sb")).select(F.col("sa").alias("string_id"), "sb")
    ids = rows.select("id", "string_id")
    half = join_on_skewed_key(ids, pairs, "string_id", heavy).select(F.col("id").alias("ia"), F.col("sb").alias("string_id"))
    out = join_on_skewed_key(ids, half, "string_id", heavy)
    return out.select(F.least("ia", "id").alias("a"), F.greatest("ia", "id").alias("b"))
