"""Problem 2: personal data in free text, by anchor expansion.

One Aho-Corasick automaton finds anchors in a folded copy of the text (same length: full-width and
other digits and letters become plain ones, lower case): at-signs and their spellings, URL schemes,
plus signs, leading zeros and grouped digits, cues of phone and identity numbers, street and box words, titles, name
cues, words after names and known names. At each anchor a local parser reads the original text to the left and right, checks
the form and gives the exact span. Parsers are bounded by words, clauses and the next cue, never by a number of
characters, so a token may have any length. Spans are settled in a fixed order (URL, identity number after its
cue, email, phone, address, name); one that overlaps an earlier one is dropped. Redaction puts ``[KIND]`` for
each span and leaves every other character alone.

Defined cases: null text stays null without kinds; blank and empty texts have no kinds; several
finds of a kind make one row in ``kinds`` and one placeholder each; texts of any length are scanned
whole; a number belongs to the nearest cue before it. The list of known names may be empty; up to ``MOST_NAMES`` names
are held in the automaton, of a longer list each row gets those it holds by a join, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise, spread, valid

MOST_NAMES = 1_000_000
KINDS = ("email", "phone", "national_id", "address", "name")

# Words that announce the number of an identity paper.
ID_CUES = (
    "nida", "nin", "passport", "passeport", "passaporte", "id number", "id no", "national number", "national id", "identity card", "identity number",
    "carte d'identité", "carte d’identité", "carte nationale", "bilhete de identidade", "cartão de cidadão", "kitambulisho", "pasipoti", "hati ya kusafiria",
    "kamazisi", "ipasi", "katin shaida", "fasfo", "nin mi", "káàdì ìdánimọ̀", "nọmba njirimara", "kaadị njirimara", "kaarka aqoonsiga", "aqoonsi", "baasaboor", "eenyummeessaa", "eenyummaa", "paaspoortii",
    "kart dàntite", "karte dàntite", "paspoor", "رقم الهوية", "بطاقة الهوية", "جواز السفر", "رقم الجواز", "الرقم الوطني", "የመታወቂያ", "መታወቂያ", "ፓስፖርት",
    "ssn", "social security", "tax number", "driver's licence", "driving licence",
)
# Words that announce a phone number.
PHONE_CUES = ("phone", "telephone", "tel", "mobile", "cell", "whatsapp", "call", "simu", "nambari ya simu", "namba ya simu", "téléphone", "portable", "telefone", "telemóvel", "waya", "lambar waya", "fóònù", "ekwentị", "ucingo", "taleefan", "telefoon", "bilbila", "هاتف", "ስልክ")
# Titles of persons.
TITLES = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "chief", "mme", "mlle", "m", "monsieur", "madame", "sr", "sra", "srta", "senhor", "senhora", "dona", "d", "bw", "bi", "bwana", "mzee",
    "mama", "baba", "malam", "mal", "hajiya", "alhaji", "alh", "oga", "madam", "mnu", "nks", "nkk", "mnumzane", "nkosikazi", "ogbeni", "ọgbẹni", "iyaafin", "mazi", "oriakụ", "obbo", "aadde", "mudane", "marwo", "serigne", "sëriñ", "soxna", "ndate", "pa",
)
TITLES_OTHER = ("السيدة", "السيد", "الدكتورة", "الدكتور", "الآنسة", "الأستاذ", "د.", "አቶ", "ወ/ሮ", "ወ/ሪት", "ዶ/ር", "ወይዘሮ", "ወይዘሪት", "ፕ/ር")
# Phrases right before a person's name.
NAME_CUES = (
    "my name is", "my name na", "i am called", "signed by", "jina langu ni", "naitwa", "sunana", "je m'appelle", "je m’appelle", "chamo-me", "o meu nome é", "igama lami ngingu", "igama lami ngu", "ngingu",
    "orúkọ mi ni", "oruko mi ni", "aha m bụ", "maqaan koo", "magacaygu waa", "tudd", "maa ngi tudd", "dem dey call me", "written by", "assinado por", "signé par", "born as", "his name is", "her name is", "née", "nascido", "nascida", "anaitwa", "il s'appelle", "elle s'appelle", "chama-se",
)
NAME_CUES_OTHER = ("اسمي", "ስሜ")
# Things that carry a family's name without being the person.
THINGS = frozenset("gadar gada the a o le la les in em à at for near daraja ponte pont bridge school shule street road mtaa rua rue titin layin umgwaqo close avenue plot lake ziwa hospitali clinic market kasuwa soko ibhuloho buundo riqicha afara afárá àkwà box no from to na wa de ya and but kila every nobody namni ninguém personne gbogbo kowane".split())
# What a named person does next, right after the name.
AFTER_NAME = ("ubuze", "aliuliza", "alisema", "ya tambaya", "ta tambaya", "ya ce", "ta ce", "perguntou", "disse que", "came about", "asked for", "asked about", "ask about", "lives at", "lives in", "a demandé", "a dit que", "habite", "na ninaishi", "anaishi", "e trabalho", "e moro", "et je", "and I", "ina zaune", "wuxuu", "bí léèrè", "jụrụ")

_CAP = r"[A-ZÀ-ÖØ-ÞƁƊƘƳỊỌỤṢẸḌ][\w'’̀-ͯ-]+"
_INIT = r"[A-ZÀ-ÖØ-Þ]\."
_NAME = re.compile(rf"{_CAP}(?:\s{_INIT}){{0,2}}(?:\s{_CAP}){{0,2}}|{_INIT}(?:\s?{_INIT})?\s{_CAP}(?:\s{_INIT})?(?:\s{_CAP})?")
_OTHER_NAME = re.compile(r"\s*[^\W\d_]+(?:\s[^\W\d_]+)?")
_SEP = r"\s*[-–—;,/|]\s*"
_ID = re.compile(r"(?<!\w)[a-z]{1,2}\d{6,9}[a-z]?(?!\w)|\d{5,8}(?:[-/]\d{2,6}){1,4}(?:[-/][a-z])?(?!\w)|\d(?:[ \-]?\d){6,20}(?!\w)")
_PHONE = re.compile(r"(?:\+|\(?0)[\d(](?:[\s.\-/()]{0,2}\d){6,16}|\(0\d{1,4}\)(?:[\s.\-]?\d){6,10}|0(?:[\s.\-]\d{3,4}){3}")
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s)"
_CUED = re.compile(r"\s*(?:(?:number|no|namba|nambari|numéro|número|lamba)\b)?[\s:.#=–-]*(\(?\d(?:[\s.\-/()]{0,2}\d){6,14})(?!\w)")
_GROUPS = re.compile(r"\d{3}-\d{3}-\d{4}(?![\w-])")
_GROUPED_ID = re.compile(r"\d{3}-\d{2}-\d{4}(?![\w-])")
_YEARS = re.compile(r"(?:1[89]|20)\d\d\s?-\s?(?:1[89]|20)\d\d$")
_CLAUSE_END = re.compile(r"[!?\n።؟]|[.](?=\s+[^\d\s][^\W\d]{3})")
_DOMAIN = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}")
_DOTTED = re.compile(r"[a-z0-9-]+(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)[a-z0-9-]+)+")
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.)[^\s<>\"'»”’]+")
_NUM = r"\d{1,5}[A-Za-z]?"
_TAIL = rf"(?:,?\s(?:quartier\s|near\s|kusa da\s|[Pp]rès de\s)?{_CAP}(?=[\s,.;:!?)\]»”\"]|$))?"
ADDRESS = re.compile(
    rf"""(?ix)(?:
      (?:p\.?\s?o\.?\s?)?box\s{_NUM} | (?:s\.\s?l\.\s?p|b\.\s?p|c\.\s?p|ap)\.?\s{_NUM} | caixa\spostal\s{_NUM} | ص\.?\s?ب\.?\s?{_NUM}
    | (?:no\.?\s|plot\s|house\s)*{_NUM},?\s[\w'’-]+\s(?:street|road|close|avenue|lane|drive|crescent|way|square|court|terrace|highway)\b
    | (?:plot|house)\s(?:no\.?\s)?{_NUM}
    | (?:nyumba\snamba|nyumba\sna\.|indlu|gida\smai\slamba|lambar?\sgida)\s{_NUM} | mtaa\swa\s[\w'’-]+\s(?:na\.?|namba)\s?{_NUM}
    | lamba\s{_NUM}\s(?:layin|titin)\s[\w'’-]+ | (?:layin|titin|umgwaqo)\s[\w'’-]+,?\s{_NUM}
    | {_NUM},?\s(?:bis\s|ter\s)?(?:rue|avenue|impasse|boulevard|allée|place)\s[\w'’-]+
    | (?:rua|travessa|avenida|av\.|largo|praça)\s(?:d[aeo]s?\s)?[\w'’-]+,?\s(?:n\.?[ºo°]\.?\s)?{_NUM}
    | (?:ojúlé|ile\snọ́mbà|ụlọ\snke|nọmba)\s{_NUM},?\s[\w'’-]+ | lakk(?:oofsa)?\.?\s?mana\s{_NUM} | mana\slakk\.?\s{_NUM} | guriga\s(?:lambarka\s)?{_NUM} | kër\sgu\s{_NUM}
    | شارع\s\w+(?:\s\w+)?،?\s(?:رقم\s)?{_NUM} | {_NUM}،?\sشارع\s\w+ | የቤት\sቁጥር\s{_NUM} | ቀበሌ\s{_NUM} | ፖ\.ሣ\.ቁ\.?\s{_NUM}
    )"""
)
_ADDRESS_CUES = (
    "box ", "s.l.p", "b.p", "c.p.", "caixa postal", "ص.ب", "ص. ب", " street", " road", " close", " avenue", " lane", " drive", " crescent", " square", " court", " terrace", " highway", "plot ", "house ", "nyumba na", "indlu ", "gida mai lamba", "lamba ", "mtaa wa ",
    "layin ", "titin ", "umgwaqo ", " rue ", " impasse ", "boulevard", "allée", " place ", "rua ", "travessa ", "avenida ", "av. ", "largo ", "praça ", "ojúlé", "ụlọ nke", "nọmba ", "mana ", "guriga ", "kër gu", "شارع", "የቤት ቁጥር", "ቀበሌ", "ፖ.ሣ",
)
# Words of an address that aren't place names.
_ADDRESS_WORDS = frozenset("no plot house street road close avenue lane drive crescent way square court terrace highway p o po box s l c b ap caixa postal nyumba namba na indlu gida mai lamba lambar mtaa wa layin titin umgwaqo bis ter rue impasse boulevard place rua travessa avenida av largo de da do das dos n mana lakk lakkoofsa guriga lambarka gu".split())
_TAIL_RE = re.compile(_TAIL)
_NOT_PHONE = re.compile(r"(?:\blots?|\blote|shelf mark|fig\.|pp?\.|vol\.|isbn|serial|ledger)\s(?:no\.?\s|n\.?º\s)?$", re.I)


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, int]:
    """Same-length folding: compatibility letters and any decimal digit to plain ones, one-to-one lower case."""
    t: dict[int, int] = {}
    for o in range(0x20000):
        if 0xD800 <= o < 0xE000:
            continue
        ch = chr(o)
        if unicodedata.category(ch) == "Nd":
            t[o] = 0x30 + unicodedata.digit(ch)
        else:
            k = unicodedata.normalize("NFKC", ch) if 0xFF00 <= o < 0xFFF0 else ch
            k = k.lower()
            if len(k) == 1 and k != ch:
                t[o] = ord(k)
    t |= {0xA0: 0x20, 0x202F: 0x20, 0x2009: 0x20, 0x2007: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2212: 0x2D}
    return t


class Finder:
    """The automaton and the parsers."""

    def __init__(self, given: set[str], family: set[str]):
        import ahocorasick

        self.given, self.family = {x.casefold() for x in given}, {x.casefold() for x in family}
        a = ahocorasick.Automaton()
        words: dict[str, set[str]] = {}

        def put(word: str, what: str) -> None:
            words.setdefault(word, set()).add(what)

        for w in ("@", " at ", "[at]", "(at)", "{at}", "<at>", "[ at ]", "( at )"):
            put(w, "email")
        for w in ("://", "www."):
            put(w, "url")
        for w in ("+", "0"):
            put(w, "phone")
        for w in "0123456789":
            put(w + "-", "groups")
        for w in PHONE_CUES:
            put(w, "phonecue")
        for w in AFTER_NAME:
            put(" " + w.lower(), "after")
        for w in ID_CUES:
            put(w.lower(), "id")
        for w in _ADDRESS_CUES:
            put(w, "address")
        for w in TITLES:
            put(w + " ", "title")
            put(w + ". ", "title")
        for w in TITLES_OTHER:
            put(w + " ", "other")
        for w in NAME_CUES:
            put(w + " ", "cue")
        for w in NAME_CUES_OTHER:
            put(w + " ", "othercue")
        for w in self.given | self.family:
            put(w, "known")
        for w in ("(", "[", "– ", "— "):
            put(w, "inset")
        for w, what in words.items():
            a.add_word(w, (len(w), tuple(what)))
        a.make_automaton()
        self.automaton, self.fold = a, _fold_table()

    def spans(self, text: str, given: set[str] | None = None, family: set[str] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all finds; ``given`` and ``family``: the known names this text holds, if they aren't in the automaton."""
        low = text.translate(self.fold)
        anchors: dict[str, list[tuple[int, int]]] = {}
        for end, (n, what) in self.automaton.iter(low):
            for w in what:
                anchors.setdefault(w, []).append((end + 1 - n, end + 1))
        if given or family:
            anchors["known"] = [(a, b) for a, b in name_places(text, low, max(map(len, (given or set()) | (family or set())))) if low[a:b] in given or low[a:b] in family]
        if not anchors:
            return []
        taken: list[tuple[int, int, str]] = []
        gaps = [m.start() for m in _GAP.finditer(low)]

        covered = bytearray(len(low))

        def put(a: int, b: int, kind: str) -> bool:
            if covered.find(1, a, b) >= 0:
                return False
            covered[a:b] = b"\1" * (b - a)
            taken.append((a, b, kind))
            return True

        def back(a: int, words: int) -> int:
            """Where the ``words`` words before ``a`` begin."""
            k = bisect_left(gaps, a) - words
            return gaps[k] if k >= 0 else 0

        def ahead(b: int, words: int) -> int:
            k = bisect_left(gaps, b) + words
            return gaps[k] if k < len(gaps) else len(low)

        for a, b in anchors.get("url", ()):
            s = a
            if low[a:b] == "://":
                while s and (low[s - 1].isalnum() or low[s - 1] in "+.-"):
                    s -= 1
            elif a and (low[a - 1].isalnum() or low[a - 1] in "@/."):
                continue
            if m := _URL.match(low, s):
                put(s, m.end(), "")
        whole = lambda a, b: not (a and low[a - 1].isalnum()) and not (low[b : b + 1].isalpha() and low[a:b].isascii())
        ids = [x for x in anchors.get("id", ()) if whole(*x)]
        calls = [(a, b) for a, b in anchors.get("phonecue", ()) if whole(a, b) and not low[b : b + 1].isalnum()]
        cues = sorted({a for a, _ in ids} | {a for a, _ in calls})
        for a, b in ids:
            k = bisect_left(cues, b)
            limit = cues[k] if k < len(cues) else len(low)  # a number belongs to the nearest cue before it
            stop = _CLAUSE_END.search(low, b, limit)
            m = _ID.search(low, b, stop.start() if stop else limit)
            if m and not low[m.start() - 1].isalnum() and low[m.start() - 1] != "+" and sum(c.isdigit() for c in m.group()) >= 6 and not _YEARS.match(m.group()):
                put(m.start(), m.end(), "national_id")
        for a, b in anchors.get("email", ()):
            self._email(low, a, b, put)
        for a, _ in anchors.get("phone", ()):
            self._phone(low, a, put)
        for _, b in calls:
            if m := _CUED.match(low, b):
                put(m.start(1), m.end(1), "phone")
        for a, _ in anchors.get("groups", ()):
            s = a - 2
            if s < 0 or (s and (low[s - 1].isalnum() or low[s - 1] in "-./+_#=@")) or _NOT_PHONE.search(low, back(s, 3), s):
                continue
            if m := _GROUPS.match(low, s):
                put(s, m.end(), "phone")
            elif m := _GROUPED_ID.match(low, s):
                put(s, m.end(), "national_id")
        if "address" in anchors:
            done = -1
            for a, b in sorted(anchors["address"]):
                if a < done:
                    continue
                for m in ADDRESS.finditer(low, back(a, 8), ahead(b, 8)):
                    if m.start() < b and m.end() > a and not (m.start() and low[m.start() - 1].isalnum()):
                        if all(w[0].isupper() or w.casefold() in _ADDRESS_WORDS or not w.isascii() for w in re.findall(r"[^\W\d_][\w'’-]*", text[m.start() : m.end()])):
                            e = m.end()
                            while (t := _TAIL_RE.match(text, e)) and t.end() > e:
                                e = t.end()
                            if put(m.start(), e, "address"):
                                done = e
        contacts = [a for a, _, kind in taken if kind in ("email", "phone")]
        self._names(text, low, anchors, put, back, contacts, given or self.given, family or self.family)
        return sorted(x for x in taken if x[2])

    @staticmethod
    def _local(low: str, s: int) -> int:
        """Where the local part that ends at ``s`` begins: letters of one kind (Latin with its accents, or any), digits and the usual signs."""
        k = s
        while k and (low[k - 1].isalnum() or low[k - 1] in "._%+-" or unicodedata.combining(low[k - 1])):
            ch = low[k - 1]
            if ord(ch) > 0x24F and not 0x300 <= ord(ch) <= 0x36F and not 0x1E00 <= ord(ch) <= 0x1EFF and any(c.isascii() and c.isalpha() for c in low[k:s]):
                break  # a word of another script in front of a Latin address
            k -= 1
        while k < s and not low[k].isalnum():
            k += 1
        return k

    @staticmethod
    def _email(low: str, a: int, b: int, put) -> None:
        word = low[a:b].strip()
        spelled = word != "@"
        s = a
        while s and low[s - 1] == " " and a - s < 1:
            s -= 1
        start = Finder._local(low, s)
        local = low[start:s]
        if not local:
            return
        e = b + (low[b : b + 1] == " ")
        d = (_DOTTED if spelled or low[b : b + 1] == " " else _DOMAIN).match(low, e)
        d = d or _DOTTED.match(low, e)
        if not d:
            return
        if spelled and not re.search(r"\bdot\b", d.group()) and not re.search(r"[\d._+-]", local):
            return
        if not spelled and " " in low[s:e] and not re.search(r"\.|dot", d.group()):
            return
        end = d.end()
        if not re.search(r"\bdot\b", d.group()):  # a plain domain ends before a sentence's full stop
            p = _DOMAIN.match(low, e)
            if not p:
                return
            end = p.end()
        put(start, end, "email")

    @staticmethod
    def _phone(low: str, a: int, put) -> None:
        if low[a] == "0" and a and low[a - 1] == "(":
            a -= 1
        if a and (low[a - 1].isalnum() or (low[a - 1] in ".,-/_+:#=@" and a > 1 and (low[a - 2].isalnum() or low[a - 1] in "+_=@#/"))):
            return
        m = _PHONE.match(low, a)
        if not m:
            return
        e = m.end()
        n = sum(c.isdigit() for c in m.group())
        if low[e : e + 1].isalnum() or not 9 <= n <= 16 or _NOT_PHONE.search(low, max(0, a - 24), a):
            return
        put(a, e, "phone")

    def _names(self, text: str, low: str, anchors: dict, put, back, contacts: list[int], given: set[str], family: set[str]) -> None:
        def start_ok(a: int) -> bool:
            return not a or not (low[a - 1].isalnum() or low[a - 1] in "'’-.@_")

        for a, b in sorted(anchors.get("title", ())):
            t = low[a:b].rstrip(". ")
            if not start_ok(a) or not text[a].isupper() or (len(t) == 1 and low[b - 2] != "."):
                continue
            m = _NAME.match(text, b)
            if m and not (len(t) == 1 and a >= 2 and low[a - 1] == " " and text[a - 2].isalpha() and text[max(0, low.rfind(" ", 0, a - 1) + 1)].isupper() and low[a - 2] not in ".:;,"):
                put(a, m.end(), "name")
        for a, b in anchors.get("cue", ()):
            if a and low[a - 1].isalnum():
                continue
            m = _NAME.match(text, b)
            if m:
                put(b, m.end(), "name")
        for a, b in anchors.get("other", ()):
            if a and (low[a - 1].isalnum()):
                continue
            m = _OTHER_NAME.match(text, b)
            if m:
                put(a, m.end(), "name")
        for a, b in anchors.get("othercue", ()):
            if a and low[a - 1].isalnum():
                continue
            m = _OTHER_NAME.match(text, b)
            if m and not any(text.startswith(t, b) for t in TITLES_OTHER):
                put(b, m.end(), "name")
        for a, b in anchors.get("known", ()):
            if not start_ok(a) or low[b : b + 1].isalnum() or not text[a].isupper():
                continue
            word = low[a:b]
            if word in given and (m := _NAME.match(text, a)) and re.search(rf"\s{_CAP}$", m.group()):
                put(a, m.end(), "name")
                continue
            if word in family and a and text[a - 1].isspace():
                at = back(a - 1, 4)
                before = _BEFORE_FAMILY.search(text, at, a)
                if before and before.group(1).casefold() not in THINGS and not (before.start() and (text[before.start() - 1].isalnum() or text[before.start() - 1] == "_")):
                    put(before.start(), b, "name")
                elif re.search(rf"{_INIT}\s$", text[max(0, a - 3) : a]):
                    put(a - 3, b, "name")
        for a, b in anchors.get("inset", ()):
            m = _INSET.match(text, b) or _INSET_OTHER.match(text, b)
            if m and m.group(1).split()[0].casefold() not in THINGS:
                put(b, m.end(1), "name")
        for p in contacts:  # a contact record: a name at the start of a line or sentence, a separator, the number or address
            if m := _RECORD.search(text, back(p, 8), p):
                words = m.group(1).casefold().split()
                if words[0] not in THINGS and (len(words) > 1 or words[0] in family or words[0] in given):
                    put(m.start(1), m.end(1), "name")
        for a, b in anchors.get("after", ()):
            if low[b : b + 1].isalnum() or text[a + 1 : b] not in _AFTER:
                continue
            m = _SUBJECT.search(text, back(a, 8), a)
            if m and m.group(1).split()[0].casefold() not in THINGS:
                put(m.start(1), m.end(1), "name")


_AFTER = frozenset(AFTER_NAME)
_GAP = re.compile(r"\s")
_BEFORE_FAMILY = re.compile(rf"({_CAP})(?:\s{_INIT}){{0,2}}\s$")
_INSET = re.compile(rf"({_CAP}(?:\s{_INIT}){{0,2}}\s{_CAP})\s?(?:[)\]]|[–—])")
_INSET_OTHER = re.compile(r"([ء-ي]+\s[ء-ي]+|[ሀ-ፚ]+\s[ሀ-ፚ]+)[)\]]")
_BEGIN = r"(?:^|[\n.!?]\s+|[\n\"«“(])\s*"
_RECORD = re.compile(rf"{_BEGIN}({_CAP}(?:\s{_INIT}){{0,2}}(?:\s{_CAP})?){_SEP}$")
_SUBJECT = re.compile(rf"{_BEGIN}({_CAP}(?:\s{_INIT}){{0,2}}\s{_CAP})$")


def name_places(text: str, low: str, longest: int) -> list[tuple[int, int]]:
    """All places where a known name of at most ``longest`` characters could stand: from a capital at a word's edge to a word's edge."""
    out = []
    ends = [m.end() for m in re.finditer(r"\w(?!\w)", low)]
    for m in re.finditer(r"(?<![\w'’\-.@])\w", low):
        a = m.start()
        if text[a].isupper():
            k = bisect_left(ends, a + 1)
            while k < len(ends) and ends[k] - a <= longest:
                out.append((a, ends[k]))
                k += 1
    return sorted(out, key=lambda x: (x[1], -x[0]))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _names_by_row(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(row, id, text, names: [(name, kind)]): each row with the listed names that it holds, by a join."""
    fold = _fold_table()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [x.translate(fold).casefold() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.string()), batch.column(1)], names=["w", "kind"])

    listed = names.mapInArrow(folded, "w string, kind string").distinct()
    longest = listed.agg(F.max(F.length("w"))).first()[0] or 0

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words = [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if t:
                    low = t.translate(fold)
                    own = {low[a:b] for a, b in name_places(t, low, longest)}
                    row += [r] * len(own)
                    words += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(words, pa.string())], names=["row", "w"])

    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text"), "lines")
    # names are distinct by (w, kind), so a word makes at most two rows; hot words lie on the rows' side, spread by the map
    own = rows.mapInArrow(places, "row bigint, w string").join(listed, "w").groupBy("row").agg(F.collect_list(F.struct("w", "kind")).alias("names"))
    return rows.join(own, "row", "left").select("id", "text", "names")


def personal_data(df: DataFrame, id_col: str, text_col: str, names: DataFrame | None = None, name_col: str = "name", kind_col: str = "kind", most_names: int = MOST_NAMES) -> DataFrame:
    """(id, kinds, redacted) of every row: the kinds found, sorted, and the text with placeholders.

    ``names``: known names with their kind (``given``, else family). A list of more than ``most_names`` isn't held by
    the workers; its names meet the rows in a join instead.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), valid(text_col).alias("text"))
    given, family, many = set(), set(), False
    if names is not None:
        clean = names.select(valid(name_col).alias("w"), F.when(F.col(kind_col) == "given", "given").otherwise("family").alias("kind")).where(F.length("w") > 0).distinct()
        listed = clean.limit(most_names + 1).collect()
        many = len(listed) > most_names
        if not many:
            given, family = ({r["w"] for r in listed if r["kind"] == k} for k in ("given", "family"))
    held = spark.sparkContext.broadcast((given, family))
    rows = _names_by_row(rows, clean) if many else spread(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                kinds, texts = [], []
                own = piece.column(2).to_pylist() if many else [None] * piece.num_rows
                for t, n in zip(piece.column(1).to_pylist(), own):
                    s = finder.spans(t, *({x["w"] for x in n or () if x["kind"] == k} for k in ("given", "family"))) if t else []
                    kinds.append(sorted({k for _, _, k in s}))
                    texts.append(redacted(t, s) if s else t)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["id", "kinds", "redacted"])

    return rows.mapInArrow(run, "id bigint, kinds array<string>, redacted string")
