"""Problem 4: sentence boundaries by a maximum-entropy classifier trained on reliable boundaries.

Candidates are runs of end marks with the closing quotes, brackets and tags that directly follow;
line breaks always end a sentence. The model is fitted on a bounded sample: of the rows of at most ``SAMPLE_CHARS``
characters the ``SAMPLE_ROWS`` with the smallest hashes of the id. Its reliable boundaries are the ends of real lines, each
looked at with the next line of the sample behind it; its reliable non-boundaries are marks inside numbers, links and
hosts, before a lower-case letter or comma, and after words that never end or before words that never start a line.
Logistic regression (maximum entropy for two classes) on mark, neighbouring tokens, case, length, digits
and script then decides every candidate of every row, whatever its length.

Defined cases: null and blank texts have no sentence; what remains at a line's end is a sentence
without a mark; tokens, gaps and next words may have any length, and a line is gone through once, in linear time; repeated
rows each get their sentences; with an empty sample the built-in abbreviations and a prior decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import spread, valid

#: The training sample: at most so many rows, and of these only rows of at most so many characters (whole; so 60 MB at most).
SAMPLE_ROWS = 30_000
SAMPLE_CHARS = 2_000
#: Dotted labels of a token that count for its look-up: abbreviations have no more.
LABELS = 8
_BREAK = "\n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
_LINES = re.compile(f"[^{_BREAK}]+")
_MARK = re.compile(r"(?:[.!?…‽。！？．։।॥።፧፨؟۔]|፡፡)+(?:[.!?…።፧؟۔]|፡፡)*")
_CLOSE = re.compile(r"(?:[\"'»”’)\]}›」』]|</[A-Za-z][A-Za-z0-9]*>|(?<=[^ \t])[ \xa0\u202f](?:»|”(?!\w)))+")
_OPEN = "\"'«“‘([{‹„¿¡*_#-–—<"
_STOP = re.compile(r"[\s፡!?።፧؟۔\"'«»“”‘’()\[\]{}<>]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_QUOTE = re.compile(r'["«“]')
_BEGUN = re.compile(r"[^\"'«“‘([{‹„¿¡*_#\-–—< \t]")
_NEXT = re.compile(r"[^\s፡.,;:!?።፣፤፧؟،\"'«»“”‘’()\[\]{}<>]+")
# Reserved names of RFC 2606 and the generic domains end a host written in capitals.
_WEB = re.compile(r"[@＠]|://|^[Ww][Ww][Ww]\.|[a-z0-9-]+\.[a-z]{2,}(?:[/?.:]|$)|[A-Z0-9-]{2,}\.(?:EXAMPLE|TEST|INVALID|COM|ORG|NET|EDU|GOV|INFO)(?![A-Z])")
# Common abbreviations of the corpus' languages that a sentence goes on after.
ABBREVIATIONS = frozenset(
    "p.o b.p s.l.p c.p av rua apt km etj kg sh no b lam lakk ikh nomb uk na v i.e e.g vol aprox pág pag p ex env f ص ዓ.ም ኪ.ግ كغ op obb ኢ.ት ዶ.ር ا د أ art al cf fig ca approx vs tel n° nr núm".split()
)

# Abbreviated titles, which count as such in capitals only.
TITLES = frozenset("mr mrs ms dr prof st bw bi mw nkk nks mnu alh mal sr sra dra m mme mlle d".split())


def is_abbreviation(token: str) -> bool:
    low = token.casefold().strip(".(")
    return low in ABBREVIATIONS or token.casefold() in ABBREVIATIONS or (low in TITLES and token.lstrip("(")[:1].isupper())


def next_start(text: str, at: int, end: int) -> tuple[str, str]:
    """(kind of gap, first character after it that isn't an opener)."""
    k = at
    while k < end and (text[k].isspace() or text[k] == "፡"):
        k += 1
    gap = "none" if k == at else "one" if k == at + 1 else "more"
    while k < end and text[k] in _OPEN and not (text[k] == "-" and gap == "none"):
        if text[k] == "<":
            tag = _TAG.match(text, k, end)
            if not tag:
                break
            k = tag.end() - 1
        k += 1
        while k < end and text[k] == " ":
            k += 1
    return gap, text[k] if k < end else ""


def kind(ch: str) -> str:
    if not ch:
        return "end"
    if ch.isupper() or ch.istitle():
        return "upper"
    if ch.islower():
        return "lower"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "letter"
    return "comma" if ch in ",;:،؛፣፤፥/=" else "other"


class Line:
    """One line while its marks are gone through from left to right; every look around a mark goes on from the last one, so a line of any length takes linear time."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.lo, self.hi = text, lo, hi
        self.run, self.seen, self.web = lo, lo, False  # start of the run of a token's characters at ``seen``; whether it is known to be a link or address
        self.word, self.over = None, hi  # the latest next word, and where none comes any more
        self.since, self.begun, self.quote = lo, lo, -1
        self.start_sentence(lo)

    def start_sentence(self, at: int) -> None:
        """Where the sentence that began at ``at`` has its first character other than openers, and its first quote after one."""
        self.since = at
        m = _BEGUN.search(self.text, at, self.hi)
        self.begun = m.start() if m else self.hi
        k = at
        while k < self.hi and self.text[k].isspace():
            k += 1
        if self.quote < min(k + 1, self.hi):
            q = _QUOTE.search(self.text, k + 1, self.hi)
            self.quote = q.start() if q else self.hi

    def token_before(self, at: int) -> str:
        """The token that ends at ``at``: at most its last ``LABELS`` dotted labels."""
        text, run = self.text, self.run
        p = text.rfind(" ", self.seen, at) + 1
        if p:
            run = p
        for m in _STOP.finditer(text, p or self.seen, at):
            run = m.end()
        if run != self.run:
            self.run, self.web = run, False
        self.seen = at
        s = at
        for _ in range(LABELS):
            s = text.rfind(".", run, s)
            if s < 0:
                return text[run:at]
        return text[s + 1 : at]

    def next_word(self, at: int) -> str:
        if self.word is None or self.word.start() < at:
            self.word = _NEXT.search(self.text, at, self.hi) if at < self.over else None
            if self.word is None:
                self.over = min(self.over, at)
        return self.word.group().casefold() if self.word else ""

    def is_web(self, token: str, m: re.Match, rest: str) -> bool:
        """Whether a mark without a gap stands in a link, host or address; what an earlier mark of the same run showed stays known."""
        if self.web:
            return True
        near = token + m.group()
        found = _WEB.search(near + rest)
        if found and (found.group()[-1] in "@＠/?.:" or found.group().endswith("://")) and found.end() <= len(near):
            self.web = True
        return bool(found)


class Candidate:
    __slots__ = ("after", "close", "ch", "gap", "in_token", "last", "mark", "next", "start", "token", "token_mark", "web", "next_word", "first", "opened")

    def __init__(self, line: Line, m: re.Match, words: bool = True):
        text, hi, mark = line.text, line.hi, m.group()
        self.start, self.after = m.start(), m.end()
        c = _CLOSE.match(text, m.end(), hi)
        self.close = c.group() if c else ""
        self.last = c.end() if c else m.end()
        self.mark = "ell" if mark.startswith(("...", "…")) else "eth" if mark[0] in "።፧፨፡" else "arab" if mark[0] in "؟۔" else "dot" if mark == "." else "strong"
        self.token = line.token_before(m.start())
        self.token_mark = self.token + ("..." if self.mark == "ell" else mark[0])
        self.gap, self.ch = next_start(text, self.last, hi)
        self.next = kind(self.ch)
        self.next_word = line.next_word(self.last) if words else ""
        self.web = False
        if self.gap == "none" and not self.close:
            rest = _NEXT.match(text, self.last, hi)
            self.web = line.is_web(self.token, m, rest.group() if rest else "")
        self.first = line.begun >= m.start() - len(self.token)
        self.opened = bool(self.close) and line.quote < m.start()

    def case(self, ends: dict, starts: dict) -> tuple:
        """What the features are made of; candidates have few different cases."""
        t = self.token
        low = t.casefold().strip(".(")
        n, e = ends.get(self.token_mark, (0, 0))
        sn, ss = starts.get(self.next_word, (0, 0))
        shape = "none" if not t else "initial" if len(low) == 1 and low.isalpha() and t[-1].isupper() else "dotted" if "." in t else "digits" if t.isdigit() else "short" if len(t) <= 3 else "word"
        last = "never" if n >= 20 and e < 0.02 * n and self.mark in ("dot", "ell") else "proven" if n >= 5 and e >= 0.1 * n else ""
        first = sn >= 20 and ss < 0.005 * sn and self.next in ("letter", "lower")
        return self.mark, self.next, self.gap, shape, is_abbreviation(t), last, first, self.web, bool(self.close), self.opened, self.mark == "ell" and self.first


def features(case: tuple) -> list[str]:
    mark, follows, gap, shape, abbreviated, last, never_first, web, closed, opened, ell_first = case
    f = ["bias", f"mark={mark}", f"next={follows}", f"gap={gap}", f"{mark}|{follows}", "decimal" if mark == "dot" and follows == "digit" and gap == "none" else f"{follows}|{gap}", f"shape={shape}", f"{shape}|{follows}"]
    if abbreviated:
        f += ["abbr", f"abbr|{follows}"]
    if last == "never":
        f += ["never-last", "never-last"]
    elif last == "proven":
        f.append("proven-last")
    if never_first:
        f += ["never-first", f"never-first|{closed}"]
    if web:
        f.append("web")
    if closed:
        f += ["closed", f"closed|{follows}", f"closed|{mark}|{opened}"]
    if ell_first:
        f.append("ell-first")
    return f


def lines_of(text: str) -> Iterator[tuple[int, int]]:
    for m in _LINES.finditer(text):
        if not m.group().isspace():
            yield m.span()


def candidates(text: str, lo: int, hi: int, words: bool = True) -> Iterator[Candidate]:
    """``words``: whether the next words are wanted."""
    line = Line(text, lo, hi)
    for m in _MARK.finditer(text, lo, hi):
        c = Candidate(line, m, words)
        yield c
        if c.gap != "none":
            line.start_sentence(c.last)


class BoundaryModel:
    """Weights and the two sample statistics."""

    def __init__(self, weights: dict[str, float], ends: dict, starts: dict):
        self.weights, self.ends, self.starts = weights, ends, starts
        self.decided: dict[tuple, bool] = {}  # the few hundred cases there are

    def is_end(self, c: Candidate) -> bool:
        if c.next == "end":
            return True
        key = c.case(self.ends, self.starts)
        got = self.decided.get(key)
        if got is None:
            got = self.decided[key] = sum(self.weights.get(f, 0.0) for f in features(key)) > 0
        return got

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence."""
        out = []
        for lo, hi in lines_of(text):
            at = lo
            for c in candidates(text, lo, hi, bool(self.starts)):
                if c.last > at and self.is_end(c):
                    if text[at : c.last].strip():
                        out.append((at, c.last))
                    at = c.last
            rest = text[at:hi]
            if rest.strip():
                out.append((at, at + len(rest.rstrip())))
        return [(a + len(text[a:b]) - len(text[a:b].lstrip()), b) for a, b in out]


def _no_end(c: Candidate, ends: dict, starts: dict) -> bool:
    """Marks that are plainly no boundary: inside links and numbers, before what goes on, after words that stand at no line's end or before words at no line's start."""
    n, e = ends.get(c.token_mark, (0, 0))
    sn, ss = starts.get(c.next_word, (0, 0))
    if c.web or c.next in ("lower", "comma") or (c.mark == "dot" and c.gap == "none" and c.next == "digit" and not c.close):
        return True
    if n >= 20 and e < 0.02 * n and c.mark in ("dot", "ell"):
        return True
    if c.mark == "dot" and is_abbreviation(c.token) and c.next in ("upper", "digit", "letter") and c.gap != "none" and e < 0.02 * max(n, 1):
        return True
    if c.mark == "dot" and len(c.token) == 1 and c.token.isupper() and c.next == "upper":
        return True
    return sn >= 20 and ss < 0.005 * sn and c.next == "letter" and (bool(c.close) or c.mark in ("ell", "dot"))


def joined_end(a: str, b: str) -> Candidate | None:
    """The end of line ``a``, as it looks with line ``b`` behind a space instead of the break; None if ``a`` ends without a mark."""
    a = a.strip()
    both = f"{a} {b.strip()}"
    for c in candidates(both, 0, len(both)):
        if c.last >= len(a):
            return c if c.last == len(a) else None
    return None


# Weights before any training, so that an empty or tiny sample still splits sensibly.
PRIOR = {"bias": 1.0, "next=lower": -4.0, "next=comma": -5.0, "next=digit": -0.5, "next=upper": 1.5, "next=letter": 1.0, "abbr": -6.0, "shape=initial": -4.0, "web": -8.0, "never-last": -3.0, "never-first": -4.0, "decimal": -6.0, "proven-last": 1.0, "ell-first": -2.0}


def train(texts: list[str], rounds: int = 25, decay: float = 1e-3) -> BoundaryModel:
    """Boundaries to learn from are the ends of real lines, each seen with the next line of the sample behind it; what is no boundary, see ``_no_end``."""
    ends, all_ends, starts, mids = Counter(), Counter(), Counter(), Counter()
    held: list[Candidate] = []
    real: list[Candidate] = []
    before = ""
    for t in texts:
        for lo, hi in lines_of(t):
            words = [w.casefold() for w in _NEXT.findall(t, lo, hi)]
            mids.update(words)
            if words:
                starts[words[0]] += 1
            for c in candidates(t, lo, hi):
                if not c.close:
                    all_ends[c.token_mark] += 1
                if c.next == "end":
                    ends[c.token_mark] += not c.close
                else:
                    held.append(c)
            line = t[lo:hi]
            if before and (c := joined_end(before, line)) is not None:
                real.append(c)
            before = line
    end_stat = {w: (n, ends[w]) for w, n in all_ends.items() if n >= 5}
    start_stat = {w: (n, starts[w]) for w, n in mids.items() if n >= 20}
    names = dict(PRIOR)
    inside = [c for c in held if _no_end(c, end_stat, start_stat)]
    cases = Counter((c.case(end_stat, start_stat), y) for y, of in ((1, real), (0, inside)) for c in of)
    kinds = list(dict.fromkeys(c for c, _ in cases))  # candidates with the same features are one weighted row
    y1 = np.array([cases[c, 1] for c in kinds], float)
    n = y1 + np.array([cases[c, 0] for c in kinds], float)
    index: dict[str, int] = {}
    for c in kinds:
        for x in features(c):
            index.setdefault(x, len(index))
    if real and inside:
        uniq = np.zeros((len(kinds), len(index)), np.float64)
        for i, c in enumerate(kinds):
            for k in features(c):
                uniq[i, index[k]] += 1
        prior = np.array([PRIOR.get(k, 0.0) for k in index])
        w = prior.copy()
        for _ in range(rounds):  # Newton steps; the prior is the centre of the penalty
            p = 1 / (1 + np.exp(-np.clip(uniq @ w, -30, 30)))
            grad = uniq.T @ (y1 - n * p) - decay * n.sum() * (w - prior) / 10 - 0.5 * (w - prior)
            h = (uniq * (n * p * (1 - p))[:, None]).T @ uniq + np.eye(len(w)) * (0.5 + decay * n.sum() / 10)
            step = np.linalg.solve(h, grad)
            w = w + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-4:
                break
        names |= {k: float(w[i]) for k, i in index.items() if not math.isnan(w[i])}
    return BoundaryModel(names, end_stat, start_stat)


def sample_texts(df: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """The bounded training sample: of the rows of at most ``SAMPLE_CHARS`` characters those with the smallest hash of their id, whole."""
    picked = df.where(F.length(text_col) <= SAMPLE_CHARS).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), valid(text_col).alias("t"))
    return [r["t"] for r in picked.orderBy("h", "t").limit(rows).collect()]


def sentences(df: DataFrame, id_col: str, text_col: str, model: BoundaryModel | None = None) -> DataFrame:
    """(id, sent_no, end_char, sentence) of every sentence of every row."""
    model = model or train(sample_texts(df, id_col, text_col))
    held = df.sparkSession.sparkContext.broadcast((model.weights, model.ends, model.starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BoundaryModel(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                row, no, end, out = [], [], [], []
                for r, t in enumerate(piece.column(1).to_pylist()):
                    if t and not t.isspace():
                        for k, (a, b) in enumerate(own.split(t)):
                            row.append(r)
                            no.append(k)
                            end.append(b)
                            out.append(t[a:b])
                if row:
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(no, pa.int32()), pa.array(end, pa.int64()), pa.array(out, pa.string())], names=["id", "sent_no", "end_char", "sentence"])

    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), valid(text_col).alias("text")))
    return rows.mapInArrow(run, "id bigint, sent_no int, end_char bigint, sentence string")
