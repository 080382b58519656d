"""Problem 5: template residue, filler, error pages and script notices.

Labelled exemplars (below; more can be passed in) are indexed by their features: words and word pairs
of a masked text, where numbers, hosts and request ids are one word per kind, and what stands between the delimiters of a
template is a slot: a word for the delimiters, one for a name between them, or the words between square brackets.
Document frequencies of all features are counted over the whole table. A line is cut into passage windows (at
most ``WINDOW`` words of one sentence); the index gives the exemplars that share features with a window, and the best
TF-IDF containment (weight of the window's features that the exemplar holds, over the window's whole weight) is its score.
A line is residue if windows scoring ``WINDOW_LEAST`` or more cover ``COVER`` of its weight. Slots are passages of
their own: a line also is residue if one is contained in a placeholder exemplar by ``WINDOW_LEAST`` or more, unless it is quoted
or its neighbours are those of an exemplar that mentions one ("the variable ...").

Words are hashed in numpy, a batch at a time; only lines with delimiters, hosts or request ids are masked by a call of their own.
Lines in which no window could reach ``WINDOW_LEAST``, whatever exemplars held its features, are dropped first: the ``COMMON``
most frequent features weigh what they weigh there and all others at least as much as the rarest of these. The
exact frequencies of all features of the rest are joined to them.

Defined cases: null, blank and wordless texts aren't residue; ordinary sentences around a notice keep
the coverage low; repeated lines are all reported; lines, words and slots may have any length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import rows_of, slices, unpack
from corpusloom.runtime import materialise, spread, valid

WINDOW = 12
STRIDE = 6
WINDOW_LEAST = 0.62
COVER = 0.8
#: Features a task holds while it counts; then it passes on what it has.
HELD = 2_000_000
#: Most features whose frequencies all workers hold: those in at least this part of all features' lines.
COMMON = 100_000

# Labelled residue, one exemplar a line; # stands for a number.
ERRORS = """
# not found the page you asked for is not on this server
http # service unavailable
error # something went wrong try again later
oops we can't find that page
page not found
this page does not exist go back to the home page
internal server error request id #
bad gateway #
gateway timeout #
access denied you do not have permission to view this page ref #
forbidden you don't have permission to access this resource
session expired please log in again
too many requests wait # seconds
database connection failed in line #
error establishing a database connection
traceback timeout while reading
this page dey miss abeg go back
page introuvable # retournez à l'accueil
erreur # page introuvable
erreur interne du serveur
erro # página não encontrada
erro interno do servidor
ukurasa huu haujapatikana kosa #
hitilafu ya seva kosa #
ba a samu wannan shafi ba #
ikhasi alitholakali #
boggan lama helin khalad #
fuulli kun hin argamne dogoggora #
ahụghị ibe a njehie #
gisuñu xët wii njuumte #
الصفحة غير موجودة خطأ #
خطأ في الخادم الداخلي
ገጹ አልተገኘም ስህተት #
the connection has timed out
fatal error call to undefined function on line #
code #
error code #
http error #
# error
an error occurred please try again later
an unexpected error occurred
an unexpected problem occurred please try again
sorry something went wrong on our end
sorry the page you are looking for could not be found
the page you requested could not be found
the requested url was not found on this server
we are sorry this page is not available
this site is down for maintenance please come back later
the site is under maintenance
we are currently performing scheduled maintenance
service temporarily unavailable
the server is temporarily unable to service your request
the server returned an error
the server did not respond in time
request timed out
connection refused
this site can't be reached
your session has expired please sign in again
you are not authorized to view this page
bad request
uncaught exception in line #
seite nicht gefunden
die seite wurde nicht gefunden fehler #
die angeforderte seite konnte nicht gefunden werden
ein fehler ist aufgetreten bitte versuchen sie es später erneut
página no encontrada error #
ha ocurrido un error inténtelo de nuevo más tarde
pagina non trovata errore #
la page que vous cherchez n'existe pas
une erreur est survenue veuillez réessayer plus tard
accès refusé
service indisponible
site en maintenance revenez plus tard
a página que procura não existe
ocorreu um erro tente novamente mais tarde
acesso negado
serviço indisponível
huduma haipatikani kwa sasa jaribu tena baadaye
an samu kuskure sake gwadawa
kuna hitilafu jaribu tena
incident #
ref #
home
contact the site owner
"""
NOTICES = """
please enable javascript to view this page
you need to turn on scripts in your browser to read this text
your browser does not run scripts turn them on and reload
this site requires javascript and cookies
javascript is disabled in your browser
javascript is required to view this page
please turn on javascript and reload the page
please allow scripts to run in your browser
allow scripts to run to continue
this page needs scripts to run please enable them
you must enable scripts to see this content
your browser does not support javascript
this app works best with javascript enabled
please enable cookies and reload the page
please complete the security check to access this site
checking if the site connection is secure
please wait while we check your browser
just a moment checking your browser
bitte aktivieren sie javascript um diese seite anzuzeigen
habilite javascript para ver esta página
abilita javascript per vedere questa pagina
javascript est désactivé dans votre navigateur
enable cookies to continue
checking your browser before opening <host> this takes about # seconds
verify you are human before continuing
veuillez activer javascript pour continuer
ative o javascript para ver o conteúdo
tafadhali washa javascript ili uone ukurasa huu
don allah kunna javascript don ganin wannan shafi
sicela uvule i javascript ukuze ubone leli khasi
fadlan daar javascript si aad u aragto boggan
javascript banaa fuula kana ilaaluuf
biko gbanye javascript ka ị hụ ibe a
taal leen javascript ngir gis xët wii
abeg on javascript make you fit see this page
يرجى تفعيل جافا سكريبت لعرض هذه الصفحة
ገጹን ለማየት ጃቫስክሪፕት ያብሩ
"""
FILLER = """
your content will appear here
sample text goes here replace this text later
this is placeholder text
coming soon
texte à venir
texte d'exemple
texto de exemplo #
texto aqui
maandishi ya mfano yatawekwa hapa
rubutun gwaji kawai
umbhalo wesibonelo kuphela
qoraal tijaabo ah
barreeffama fakkeenyaa
ọ̀rọ̀ àpẹẹrẹ nìkan
ederede nlele
mbind mu misaal
نص تجريبي فقط
هذا نص مؤقت
የናሙና ጽሑፍ
todo write the story of # words
insert text here
your text goes here
replace this with your own text
this is a sample page
content goes here
add your description here
description coming soon
under construction
page under construction
work in progress
to be added
dummy text
beispieltext hier einfügen
texto de ejemplo
test test test #
asdf asdf qwer asdf
qwerty qwerty
xxx xxx xxx xxx
bla bla bla
"""
# Words of the usual Latin filler, in any order.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
# What stands between brackets that nobody filled in.
BLANKS = """
your text here
your name here
insert sentence here
insert text here
insert name here
enter text
nom du village
votre texte ici
insérer le texte ici
o seu texto aqui
inserir texto aqui
weka maandishi hapa
weka jina hapa
andika hapa
saka suna a nan
saka rubutu a nan
faka igama lapha
faka umbhalo lapha
geli magaca halkan
maqaa asitti galchi
fi orúkọ sí ibí
tinye aha ebe a
duggalal tur fii
أدخل النص هنا
أدخل الاسم هنا
ስም እዚህ ያስገቡ
title
name
author
date
city
body
headline
speaker
place name
first name
jina
nom
nome
suna
"""

# One template slot of each kind.
SLOTS = """
{{ name }}
{{ name|filter }}
{% block name %}
<% name %>
<%= name %>
<<name>>
${name}
#{name}
%(name)s
%%name%%
@@name@@
[[name]]
$name$
__name__
{name}
{0}
"""
# Words before or after a slot (<slot>) in sentences that are about it.
MENTIONS = """
variable <slot>
the variable <slot>
parameter <slot>
function <slot>
method <slot>
class <slot>
module <slot>
file <slot>
symbol <slot>
token <slot>
tag <slot>
macro <slot>
placeholder <slot>
notation <slot>
called <slot>
named <slot>
write <slot>
type <slot>
formula <slot>
where <slot>
<slot> is a
<slot> denotes
<slot> means
<slot> method
<slot> function
<slot> variable
<slot> notation
<slot> syntax
<slot> stands
variabel <slot>
fonction <slot>
função <slot>
kigezo <slot>
"""

#: Words that stand for masked things: code points of a private area, which no text of the corpus is meant to hold.
SLOT, NAME, LETTER, HOST, OPEN, CLOSE_, QUOTED = (chr(0xE000 + k) for k in range(7))
_SHAPES = ("{{", "{%", "<%", "<<", "${", "#{", "%(", "%%", "@@", "[[", "$", "__", "{")
_SHAPE = {x: chr(0xE010 + k) for k, x in enumerate(_SHAPES)}
_PH = re.compile(
    r"(?P<a>\{\{)(?P<an>[^{}\n]*)\}\}|(?P<b>\{%)(?P<bn>[^{}\n]*)%\}|(?P<c><%)(?P<cn>[^<>\n]*)%>|(?P<d><<)\s?(?P<dn>[\w.]+)\s?>>|(?P<e>[$#]\{)(?P<en>[^{}\n]+)\}|(?P<f>%\()(?P<fn>[\w.]+)\)[sdf]?|(?P<g>%%)(?P<gn>[\w.]+)%%|(?P<h>@@)(?P<hn>[\w.]+)@@|"
    r"(?P<i>\[\[)(?P<in>[\w. ]+)\]\]|(?<![\w$])(?P<j>\$)(?P<jn>[A-Za-z_][\w.]*)\$|(?<!\w)(?P<k>__)(?P<kn>[A-Za-z][A-Za-z0-9_.]*?)__(?!\w)|(?<![{\w\"])(?P<l>\{)(?P<ln>\d+|[A-Za-z_][\w.]*)\}(?!\})"
)
_BLANK = re.compile(r"\[([^\W\d_][^\[\]\n]{2,})\]")
_HOST = re.compile(r"(?:https?://)?(?<![a-z0-9-])(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[^\s<>]*)?", re.I)
_MAY_SLOT = re.compile(r"[{%$@]|<[<%]|\[\[|__")
_MAY_HOST = re.compile(r"\.[A-Za-z]")
_MARKUP = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?/?>")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b", re.I)
#: The name of a site before the message: ``[name]``, a host, or one or two lower-case words with a colon at a line's start.
_SITE = re.compile(rf"^[\s#*>|-]*(?:\[([a-z][\w-]+)\]|[a-z][\w-]*(?:\s[a-z]+)?:(?=\s)|{HOST}\s*[|:–-])\s*", re.M)
#: Lines that hold something to mask (a pattern of Arrow's engine).
_SPECIAL = r"[{}\[\]<>$%@]|__|\.[A-Za-z]|[0-9][A-Fa-f]|[A-Fa-f][0-9]|(?m:^[\s#*>|-]*[a-z][\w-]*(?:\s[a-z]+)?:)"
_QUOTES = {"`": "`", "'": "'", '"': '"', "“": "”", "‘": "’", "«": "»"}


def exemplars() -> list[tuple[str, str]]:
    """(kind, text) of the built-in labelled exemplars."""
    out = [("error", x) for x in ERRORS.strip().split("\n")] + [("notice", x) for x in NOTICES.strip().split("\n")] + [("filler", x) for x in FILLER.strip().split("\n")]
    out += [("placeholder", x) for x in SLOTS.strip().split("\n")] + [("placeholder", f"[{x}]") for x in BLANKS.strip().split("\n")]
    return [*out, *[("mention", x.replace("<slot>", SLOT)) for x in MENTIONS.strip().split("\n")], ("bag", LOREM)]


_BLANK_SET = frozenset(BLANKS.strip().split("\n"))


def masked(text: str) -> str:
    """The text with a word for each slot, host and request id, and without markup and the names of sites."""

    def slot(m: re.Match) -> str:
        kind = next(k for k in "abcdefghijkl" if m.group(k) is not None)
        name = m.group(kind + "n").strip()
        a, b = m.start(), m.end()
        quoted = a and b < len(text) and _QUOTES.get(text[a - 1]) == text[b]
        return f" {_SHAPE[m.group(kind)]} {LETTER if len(name) == 1 and name.isalpha() else NAME} {CLOSE_} {QUOTED if quoted else ''} "

    def blank(m: re.Match) -> str:
        x = m.group(1)
        return m.group() if x.startswith(("U+", "u+")) or x.strip() in ("at", "dot") else f" {OPEN} {x} {CLOSE_} "

    t = _PH.sub(slot, text) if _MAY_SLOT.search(text) else text
    t = _MARKUP.sub(" ", t) if "<" in t else t
    t = _HOST.sub(f" {HOST} ", t) if _MAY_HOST.search(t) else t
    t = _SITE.sub(lambda m: "" if (m.group(1) or "").replace("_", " ") not in _BLANK_SET else m.group(), t)
    return _HEX.sub(" 0 ", _BLANK.sub(blank, t) if "[" in t else t)


_SPACE, _BREAK, _END = 8, 16, 32


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point (0 gap, 1 letter, 2 digit, 3 dropped inside words, 4 a masked thing; flags of space, line break and end mark) and its lower-case form."""
    top = 0x30000
    kind, low = np.zeros(top, np.uint8), np.arange(top, dtype=np.int64)
    for o in range(top):
        if 0xD800 <= o < 0xE000:
            continue
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat[0] in "LM":
            kind[o] = 1
            l = ch.lower()
            if len(l) == 1:
                low[o] = ord(l)
        elif cat == "Nd":
            kind[o] = 2
        elif ch in "'’‘ʼ" or cat == "Cf":
            kind[o] = 3
        elif ch.isspace():
            kind[o] = _SPACE | (_BREAK if ch in "\n\r" else 0)
        elif ch in ".!?።؟":
            kind[o] = _END
    kind[0xE000:0xE030] = 4
    return kind, low


_GROUP = np.array([0, 1, 1, 0, 4, 0, 0, 0], np.uint8)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, sentence) of the words of masked texts; a number is one word whatever its digits, a sentence's number grows over all rows."""
    kind, low = _classes()
    cps, bounds = unpack(col)
    row = rows_of(bounds)
    if len(cps) and int(cps.max()) >= len(kind):
        cps = np.where(cps < len(kind), cps, 0xFFFD)
    k = kind[cps]
    after = np.append(k[1:] & _SPACE, _SPACE)
    after[bounds[1:-1][bounds[1:-1] > 0] - 1] = _SPACE  # the end of a row
    sentence = np.cumsum((k & _BREAK) | ((k & _END) & (after << 2)) > 0)
    k &= 7
    keep = k != 3
    cps, row, k, sentence = cps[keep], row[keep], k[keep], sentence[keep]
    if not (k > 0).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = _GROUP[k]  # letters and digits make words together; a masked thing is a word by itself
    new = (group > 0) & np.concatenate([[True], (group[1:] != group[:-1]) | (row[1:] != row[:-1]) | (group[1:] == 4)])
    first, at = np.flatnonzero(new), np.flatnonzero(group > 0)
    no = np.cumsum(new)[at] - 1
    x = _hash((low[cps[at]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (at - first[no]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    starts = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]]))
    h = _hash(np.add.reduceat(x, starts))
    h[np.add.reduceat((k[at] != 2).astype(np.int64), starts) == 0] = NUMBER
    edge = sentence[first] + row[first]  # a new row begins a new sentence too
    return h, row[first], edge


NUMBER = np.uint64(35)


def pairs_of(h: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the pairs of neighbours within a sentence; the place is that of the first word."""
    if len(h) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(sentence[1:] == sentence[:-1])
    return _hash(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1] + np.uint64(7)), at


def prepared(texts: pa.Array) -> pa.Array:
    """Masked texts; only those with something to mask are touched, and quotes of words go with them."""
    special = pc.fill_null(pc.match_substring_regex(texts, _SPECIAL), False)
    if not pc.any(special).as_py():
        return texts
    where = np.flatnonzero(special.to_numpy(zero_copy_only=False))
    made = [masked(t) for t in texts.take(pa.array(where)).to_pylist()]
    return pc.replace_with_mask(texts, special, pa.array(made, texts.type))


def features_of(text: str) -> list[int]:
    """Features of one text in order: words, then pairs."""
    h, _, s = words_of(pa.array([masked(text)], pa.string()))
    return [*h.tolist(), *pairs_of(h, s)[0].tolist()]


class ResidueIndex:
    """Inverted index of the exemplars with the table's document frequencies."""

    def __init__(self, items: list[tuple[str, str]], df: dict[int, int], n: int, common: tuple[np.ndarray, np.ndarray] | None = None, edge: int | None = None):
        self.kinds = [k for k, _ in items]
        self.posting: dict[int, list[int]] = defaultdict(list)
        self.mention: set[int] = set()
        for i, (kind, text) in enumerate(items):
            h, _, s = words_of(pa.array([masked(text.replace("#", "0") if kind != "placeholder" else text)], pa.string()))
            both = pairs_of(h, s)[0].tolist()
            if kind == "mention":
                self.mention |= set(both)
                continue
            for f in {*h.tolist(), *(() if kind == "bag" else both)}:
                self.posting[f].append(i)
        self.n = max(n, 1)
        self.weight = {f: self.idf(df.get(f, 0)) for f in self.posting}
        self.weight[int(NUMBER)] = min(self.weight.get(int(NUMBER), 1.0), 1.0)
        self.keys = np.array(sorted(self.posting), np.uint64)
        self.values = np.array([self.weight[k] for k in self.keys.tolist()])
        # frequent features with their frequencies; all others stand in fewer than ``edge`` lines
        keys, often = common or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.common, self.common_weight = keys, np.log((self.n + 1) / (often + 1)) + 1
        self.rare = self.idf(self.n if edge is None else edge)
        word = lambda c: int(words_of(pa.array([c]))[0][0])
        self.opens, self.close, self.quoted, self.slot = {word(c) for c in (*_SHAPE.values(), OPEN)}, word(CLOSE_), word(QUOTED), word(SLOT)
        self.other: dict[int, float] = {}  # weights of the line's features that no exemplar has

    def idf(self, df: int) -> float:
        return math.log((self.n + 1) / (df + 1)) + 1

    def known(self, f: np.ndarray) -> np.ndarray:
        """Weight of each feature that an exemplar has, else 0."""
        at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        return np.where(self.keys[at] == f, self.values[at], 0.0)

    def at_least(self, f: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What each feature weighs at least: exact for those of exemplars (``own``) and frequent ones."""
        if not len(self.common):
            return np.where(own > 0, own, self.rare)
        at = np.minimum(np.searchsorted(self.common, f), len(self.common) - 1)
        return np.where(own > 0, own, np.where(self.common[at] == f, self.common_weight[at], self.rare))

    def possible(self, h: np.ndarray, row: np.ndarray, sentence: np.ndarray, rows: int) -> np.ndarray:
        """Rows in which a window could score ``WINDOW_LEAST``, and rows with a slot."""
        out = np.zeros(rows, bool)
        if not len(h):
            return out
        out[row[np.isin(h, np.array(sorted(self.opens), np.uint64))]] = True
        own = self.known(h)
        pair = np.zeros(len(h))
        pair_all = np.zeros(len(h))
        p, at = pairs_of(h, sentence)
        pair[at] = self.known(p)
        pair_all[at] = self.at_least(p, pair[at])
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (own, self.at_least(h, own), pair, pair_all)]
        a, b = windows_of(sentence)
        got, whole = sums[0][b] - sums[0][a], sums[1][b] - sums[1][a]
        pgot, pwhole = sums[2][b - 1] - sums[2][a], sums[3][b - 1] - sums[3][a]  # the last word's pair lies outside
        reach = np.maximum((got + pgot) / (whole + pwhole), got / whole)
        out[row[a[reach >= WINDOW_LEAST - 1e-9]]] = True
        return out

    def best(self, words: list[int], pairs: list[int]) -> tuple[float, float, str]:
        """(containment, weight, kind) of one passage."""
        total = bag_total = 0.0
        got: dict[int, float] = defaultdict(float)
        for k, f in enumerate((*words, *pairs)):
            w = self.weight.get(f)
            v = self.other.get(f, 1.0) if w is None else w
            total += v
            if k < len(words):
                bag_total += v
            if w is not None:
                for i in self.posting[f]:
                    got[i] += w
        top, kind = 0.0, ""
        for i, g in got.items():
            c = g / (bag_total if self.kinds[i] == "bag" else total)
            if c > top:
                top, kind = c, self.kinds[i]
        return top, total, kind

    def has_placeholder(self, h: list[int]) -> bool:
        """Whether a slot is contained in a placeholder exemplar and isn't only spoken of."""
        for a, f in enumerate(h):
            if f not in self.opens:
                continue
            b = h.index(self.close, a + 1)  # masking writes them in pairs
            words = h[a : b + 1]
            pairs = pairs_of(np.array(words, np.uint64), np.zeros(len(words)))[0].tolist()
            c, _, kind = self.best(words, pairs)
            if c < WINDOW_LEAST or kind != "placeholder" or (b + 1 < len(h) and h[b + 1] == self.quoted):
                continue
            around = [x for x in ((h[a - 1], self.slot) if a else None, (self.slot, h[b + 1]) if b + 1 < len(h) else None) if x]
            if not any(int(pairs_of(np.array(x, np.uint64), np.zeros(2))[0][0]) in self.mention for x in around):
                return True
        return False

    def verdict(self, h: np.ndarray, sentence: np.ndarray, df: dict[int, int]) -> tuple[float, str]:
        """(coverage, kind) of a line's words: coverage 1 and kind placeholder for a line with a placeholder.

        ``df``: document frequencies of the line's features that no exemplar has.
        """
        self.other = {f: self.idf(n) for f, n in df.items()}
        words = h.tolist()
        if not words:
            return 0.0, ""
        if self.has_placeholder(words):
            return 1.0, "placeholder"
        p, at = pairs_of(h, sentence)
        place = dict(zip(at.tolist(), p.tolist()))
        by: Counter = Counter()
        whole = good = 0.0
        for a, b in zip(*(x.tolist() for x in windows_of(sentence))):
            c, w, kind = self.best(words[a:b], [place[k] for k in range(a, b - 1)])
            whole += w
            if c >= WINDOW_LEAST and kind != "placeholder":
                good += w
                by[kind] += w
        return (good / whole if whole else 0.0), (by.most_common(1)[0][0] if by else "")


def windows_of(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the passage windows: ``WINDOW`` words of a sentence every ``STRIDE``, the last one up to its end."""
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    size = np.diff(np.append(first, len(sentence)))
    count = 1 + np.maximum(0, -((WINDOW - size) // STRIDE))
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    a = np.repeat(first, count) + STRIDE * k
    return a, np.minimum(a + WINDOW, np.repeat(first + size, count))


def residue(df: DataFrame, id_col: str, text_col: str, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, kind, coverage, is_residue) of every row that has words."""
    spark = df.sparkSession
    items = exemplars() + (more or [])
    wanted = frozenset(f for _, text in items for f in features_of(text.replace("#", "0")) + features_of(text))
    signed = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = 0, [], 0

        def counted() -> pa.RecordBatch:
            f, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            key = pa.concat_arrays([pa.array([None], pa.int64()), signed(f)])
            return pa.RecordBatch.from_arrays([key, pa.concat_arrays([pa.array([n], pa.int64()), pa.array(c, pa.int64())])], names=["f", "n"])

        for batch in batches:
            for at, rows in slices(batch.column(0)):
                n += rows
                h, row, s = words_of(prepared(batch.column(0).slice(at, rows)))
                p, place = pairs_of(h, s)
                both, of = np.concatenate([h, p]), np.concatenate([row, row[place]])
                _, one = np.unique(both ^ _hash(of.astype(np.uint64) + np.uint64(1)), return_index=True)  # once a line
                held.append(both[one])
                size += len(one)
                if size >= HELD:
                    yield counted()
                    n, held, size = 0, [], 0
        yield counted()

    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), valid(text_col).alias("text")))
    counts = materialise(rows.select("text").mapInArrow(count, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")), "features")
    few = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(wanted)], "f bigint")
    stats = {int(np.int64(r["f"]).view(np.uint64)): r["n"] for r in counts.join(F.broadcast(few), "f").collect()}
    sums = counts.agg(F.sum(F.when(F.col("f").isNull(), F.col("n"))).alias("lines"), F.sum(F.when(F.col("f").isNotNull(), F.col("n"))).alias("features")).first()
    lines, edge = sums["lines"] or 0, max(1, math.ceil((sums["features"] or 0) / COMMON))
    often = counts.where(F.col("f").isNotNull() & (F.col("n") >= edge)).toPandas()  # at most COMMON of them
    often = (often["f"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64))
    order = np.argsort(often[0])
    held = spark.sparkContext.broadcast((items, stats, lines, (often[0][order], often[1][order]), edge))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ResidueIndex(*held.value)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                yield part.filter(pa.array(index.possible(*words_of(prepared(part.column(1))), n)))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(wanted), np.uint64)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                h, row, s = words_of(prepared(batch.column(1).slice(at, n)))
                p, place = pairs_of(h, s)
                both = np.unique(np.stack([np.concatenate([row, row[place]]).astype(np.uint64), np.concatenate([h, p])]), axis=1)
                both = both[:, ~np.isin(both[1], known)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).take(pa.array(both[0].astype(np.int64))), signed(both[1])], names=["key", "f"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ResidueIndex(*held.value)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                h, row, s = words_of(prepared(part.column(1)))
                bounds = np.searchsorted(row, np.arange(n + 1))
                kept, kinds, cover = [], [], []
                for r, own in enumerate(part.column(2).to_pylist()):
                    i = slice(bounds[r], bounds[r + 1])
                    c, kind = index.verdict(h[i], s[i], {int(np.int64(x["f"]).view(np.uint64)): x["n"] for x in own or ()})
                    if c > 0:
                        kept.append(r)
                        kinds.append(kind)
                        cover.append(c)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.array(kinds, pa.string()), pa.array(cover, pa.float64()), pa.array([c >= COVER for c in cover], pa.bool_())], names=["id", "kind", "coverage", "is_residue"])

    kept = rows.mapInArrow(possible, "id bigint, text string").withColumn("key", F.monotonically_increasing_id())
    kept = materialise(kept, "lines")
    own = kept.select("key", "text").mapInArrow(other, "key bigint, f bigint").join(counts, "f")
    own = own.groupBy("key").agg(F.collect_list(F.struct("f", "n")).alias("own"))
    return kept.join(own, "key", "left").select("id", "text", "own").mapInArrow(score, "id bigint, kind string, coverage double, is_residue boolean")
