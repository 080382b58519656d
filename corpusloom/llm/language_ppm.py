"""Problem 6: language of documents and of their parts, by prediction by partial matching.

For each language a context tree over the bytes of labelled samples holds, for contexts of up to
``ORDER`` bytes, how often each byte followed (frozen statistics). A byte's code length is that of PPM
with escape method C: at the longest known context the byte's share, or an escape and the next shorter
context, down to a uniform byte. All languages share one sorted table of context and byte hashes with a
column per language, so a batch is scored with ``ORDER + 1`` searches and gathers, whatever the number of
languages.

A document is cut into sentences, each sentence is scored, and short sentences take over the language
of a neighbour unless the code lengths speak clearly. The confidence of a segment is the posterior of
its language under equal priors with the code length tempered by ``TEMPER``. Text is lowered, digits,
links and tags are masked, and each sample also counts without its accents, so that capitals and
dropped accents keep their language.

Bounds: the trees are fitted on whole samples, in the order of their hashes, of at most ``SAMPLES_PER_LANGUAGE`` rows
and ``SAMPLE_CHARS`` characters a language together; if the table of costs still came out above ``MODEL_BYTES``, which
is what is broadcast, both bounds are halved until it fits.

Defined cases: null texts and texts without letters have no segments; a whole sentence has two words or more, in any
script; documents of any length are cut into sentences first; repeated rows are scored each; a language
without samples, or with none within the bounds, cannot be found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sentence_bounds import PRIOR, BoundaryModel
from corpusloom.runtime import spread, valid

ORDER = 6
#: Words of a whole sentence.
LEAST = 2
TEMPER = 0.35
#: Bits, and share of its own code length, that a sentence must save to leave the main language of its document.
LEAST_SAVED, LEAST_SHARE = 20.0, 0.3
#: Most rows per language of the labelled samples that the trees are fitted on.
SAMPLES_PER_LANGUAGE = 2000
#: Most characters per language of these samples, and most bytes of the fitted table.
SAMPLE_CHARS = 60_000
MODEL_BYTES = 256 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NOISE = re.compile(r"https?://\S+|www\.\S+|(?<![a-z0-9-])[a-z0-9-]+(?:\.[a-z0-9-]+)+/\S*|[#@]\w+|</?\w+>|[\d٠-٩]+", re.I)

_MAY_NOISE = re.compile(r"[/#@<]|www\.", re.I)


def plain(text: str) -> str:
    """What is scored: composed, lower case, links, tags and numbers gone, single spaces."""
    t = unicodedata.normalize("NFC", _NOISE.sub(" ", text)).lower()
    return " " + " ".join(re.findall(r"[^\W_]+(?:['’̀-ͯ][^\W_]*)*", t)) + " "


@lru_cache(maxsize=1)
def _word_kinds() -> np.ndarray:
    """Of each code point: 1 part of a word, 2 part of one that has begun, 3 line break, 0 anything else."""
    out = np.zeros(0x110000, np.uint8)
    out[[o for o in range(0x32400) if chr(o).isalnum() and not chr(o).isdecimal()]] = 1  # no letters lie beyond
    out[[ord("'"), ord("’"), *range(0x300, 0x370)]] = 2
    out[10] = 3
    return out


def plain_all(texts: list[str]) -> list[str]:
    """``plain`` of many texts without line breaks, in one go."""
    if not texts:
        return []
    clean = [_NOISE.sub(" ", t) if _MAY_NOISE.search(t) else t for t in texts]  # digits go by their kind
    whole = unicodedata.normalize("NFC", " \n ".join(["", *clean, ""])).lower()
    cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = _word_kinds()[cps]
    begun = np.maximum.accumulate(np.where(kind != 2, np.arange(len(kind)), 0))  # the last place that is no mark
    word = (kind == 1) | ((kind == 2) & (kind[begun] == 1))
    gap = ~word & (kind != 3)
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # of a gap the first place
    keep[0] = True
    parts = np.where(gap, np.uint32(32), cps)[keep].tobytes().decode("utf-32-le").split("\n")[1:-1]
    return [p if p != " " else "  " for p in parts]


@lru_cache(maxsize=1)
def _is_mark() -> np.ndarray:
    """Whether each code point is a combining mark."""
    out = np.zeros(0x110000, bool)
    out[[o for o in range(0x300, 0x1F000) if unicodedata.combining(chr(o))]] = True
    return out


def bare(text: str) -> str:
    """Without accents and other combining marks."""
    if text.isascii():
        return text
    cps = np.frombuffer(unicodedata.normalize("NFD", text).encode("utf-32-le"), np.uint32)
    return cps[~_is_mark()[cps]].tobytes().decode("utf-32-le")


class Places:
    """Places of 64-bit keys in a table of open addressing, a quarter full; look-ups of whole arrays take about one probe."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.table = np.full(self.size, -1, np.int32)
        left, step = np.arange(len(keys), dtype=np.int32), 0
        home = self._home(keys)
        while len(left):
            at = (home[left] + step) & (self.size - 1)
            free = np.flatnonzero(self.table[at] < 0)
            self.table[at[free]] = left[free]
            left = left[self.table[at] != left]
            step += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.table[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & (self.size - 1)
            got = self.table[at]
            out[wrong] = got
            more = (got >= 0) & (self.keys[got] != keys[wrong])
            wrong, at = wrong[more], at[more]
        return out


class PPM:
    """Frozen context trees of all languages as one table of costs in bits.

    ``cost[g]`` is the code length of the byte of gram ``g`` after its context, under every language,
    with all escapes below it settled; ``esc[c]`` are the bits to leave context ``c`` (0 where a language
    doesn't know it). A byte so costs the row of its longest known gram and the escapes above it.
    """

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        n, trees = len(self.langs), []
        for lang in self.langs:
            text = "".join(dict.fromkeys(v for s in samples[lang] for v in (plain(s), bare(plain(s))))).encode()
            trees.append(self._tree(np.frombuffer(text, np.uint8)))
        keys, below, costs, contexts, escapes = [], None, None, [], []
        for k in range(order + 1):
            level = [t[k] for t in trees]
            gk, first = np.unique(np.concatenate([x["gram"] for x in level] or [np.zeros(0, np.uint64)]), return_index=True)
            parent = np.concatenate([x["parent"] for x in level] or [np.zeros(0, np.uint64)])[first]
            of = np.concatenate([x["of"] for x in level] or [np.zeros(0, np.uint64)])[first]
            ck = np.unique(np.concatenate([x["ctx"] for x in level] or [np.zeros(0, np.uint64)]))
            esc, hit = np.zeros((len(ck), n), np.float32), np.full((len(gk), n), np.nan, np.float32)
            for i, x in enumerate(level):
                esc[np.searchsorted(ck, x["ctx"]), i] = np.log2((x["n"] + x["kinds"]) / x["kinds"])
                hit[np.searchsorted(gk, x["gram"]), i] = np.log2((x["n"] + x["kinds"])[x["owner"]] / x["count"])
            rest = np.full((len(gk), n), 8.0, np.float32) if below is None else costs[np.searchsorted(below, parent)]
            cost = np.where(np.isnan(hit), esc[np.searchsorted(ck, of)] + rest, hit)
            keys.append(gk)
            contexts.append(ck)
            escapes.append(esc)
            below, costs = gk, cost
            self.__dict__.setdefault("_costs", []).append(cost)
        self.grams, self.contexts, self.escapes, self.costs = keys, contexts, escapes, self.__dict__.pop("_costs", [])
        self.find_gram, self.find_context = [Places(k) for k in self.grams], [Places(k) for k in self.contexts]

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for group in (self.grams, self.contexts, self.escapes, self.costs) for x in group)

    def _hashes(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each order, the hash of the bytes before each of some places (row ``k``: the k bytes before)."""
        out, h = [np.full(len(at), 1, np.uint64)], np.zeros(len(at), np.uint64)
        before = np.concatenate([np.zeros(self.order, np.uint64), data.astype(np.uint64) + np.uint64(1)])  # zeros where the text has not begun
        for k in range(1, self.order + 1):
            h = h + before[at + (self.order - k)] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64))
            x = (h ^ (h >> np.uint64(31))) * _MIX + np.uint64(k + 1)
            out.append(x ^ (x >> np.uint64(29)))
        return out

    @staticmethod
    def _with(ctx: np.ndarray, data: np.ndarray) -> np.ndarray:
        x = (ctx + (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def _tree(self, data: np.ndarray) -> list[dict]:
        """Per order: grams with their count, context and next shorter gram; contexts with their count and kinds of bytes."""
        hashes, out = self._hashes(data, np.arange(len(data))), []
        for k, ctx in enumerate(hashes):
            c, b = ctx[k:], data[k:]
            gram, first, count = np.unique(self._with(c, b), return_index=True, return_counts=True)
            of = c[first]
            parent = self._with(hashes[k - 1][k:][first], b[first]) if k else np.zeros(len(gram), np.uint64)
            cu, owner = np.unique(of, return_inverse=True)
            out.append({"gram": gram, "count": count.astype(float), "of": of, "parent": parent, "owner": owner, "ctx": cu, "n": np.bincount(owner, weights=count), "kinds": np.bincount(owner).astype(float)})
        return out

    def bits(self, data: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Code length in bits of each row under each language; contexts don't cross rows.

        A word with its space costs the same wherever the bytes before it are the same, so each is scored once a call.
        """
        n = len(self.langs)
        out = np.zeros((rows, n))
        if not len(data) or not n:
            return out
        start = np.searchsorted(row, np.arange(rows))
        depth = np.arange(len(data)) - start[row]
        first = np.flatnonzero((data == 32) | (depth == 0))
        size = np.diff(np.append(first, len(data)))
        places = np.arange(len(data)) - np.repeat(first, size)
        key = np.add.reduceat(self._with(places.astype(np.uint64) * _MIX, data), first)
        key = (key ^ self._hashes(data, first)[self.order]) * _MIX + np.minimum(depth[first], self.order).astype(np.uint64)
        _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        size = size[one]
        begin = np.cumsum(size) - size
        at = np.repeat(first[one] - begin, size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(one)), size)
        spans = np.zeros((len(one), n))
        for k in range(0, len(at), 1 << 15):
            part = at[k : k + (1 << 15)]
            self._add(spans, owner[k : k + (1 << 15)], self._costs_at(data[part], depth[part], self._hashes(data, part)))
        self._add(out, row[first], spans[inverse])
        return out

    def _costs_at(self, b: np.ndarray, deep: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        """Bits of some bytes, from how many bytes stand before them in their row and the hashes of these."""
        cost, todo = np.zeros((len(b), len(self.langs)), np.float32), np.arange(len(b))
        for k in range(self.order, -1, -1):
            fits = deep[todo] >= k
            here = todo if fits.all() else todo[fits]
            if not len(here) or not len(self.grams[k]):
                continue
            c = hashes[k][here]
            gi = self.find_gram[k].find(self._with(c, b[here]))
            hit = gi >= 0
            cost[here[hit]] += self.costs[k][gi[hit]]
            miss = here[~hit]
            ci = self.find_context[k].find(c[~hit])
            known = ci >= 0
            cost[miss[known]] += self.escapes[k][ci[known]]
            todo = miss if len(here) == len(todo) else np.concatenate([miss, todo[~fits]])
        cost[todo] += np.float32(8.0)
        return cost

    @staticmethod
    def _add(out: np.ndarray, r: np.ndarray, cost: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[first]] += np.add.reduceat(cost, first, axis=0)

    def score(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        return self.score_plain(plain_all([t.replace("\n", " ") for t in texts]))

    def score_plain(self, texts: list[str]) -> np.ndarray:
        """The same for texts that went through ``plain``."""
        enc = [t.encode() for t in texts]
        size = np.array([len(e) for e in enc], np.int64)
        return self.bits(np.frombuffer(b"".join(enc), np.uint8), np.repeat(np.arange(len(enc)), size), len(enc))


_SPLIT = BoundaryModel(dict(PRIOR), {}, {})
_QUOTE = re.compile(r"[\"“«][^\"”»“«\n]{2,120}[\"”»]")


def units(text: str) -> list[str]:
    """Sentences of a text that have letters."""
    return [text[a:b] for a, b in _SPLIT.split(text) if any(c.isalpha() for c in text[a:b])]


def letters(plain_text: str) -> int:
    """Letters of a text that went through ``plain``."""
    return len(plain_text) - plain_text.count(" ")


def words(plain_text: str) -> int:
    """Words of a text that went through ``plain``."""
    return max(0, plain_text.count(" ") - 1)


def assign(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, confidence) of each sentence of one document."""
    if not len(bits) or not bits.shape[1]:
        return np.zeros(0, int), np.zeros(0)
    least = bits.min(axis=1)
    main = int(bits.sum(axis=0).argmin())
    # a sentence keeps a language of its own only if that saves a clear number of bits against the document's
    own = bits[:, main] - least > np.maximum(LEAST_SAVED, LEAST_SHARE * least)
    lang = np.where(own, bits.argmin(axis=1), main)
    p = np.exp(-(bits - least[:, None]) * TEMPER)
    return lang, p[np.arange(len(lang)), lang] / p.sum(axis=1)


def labelled(samples: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = SAMPLES_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """The bounded training sample: whole texts of each language by their hashes, at most ``most`` and ``chars`` characters of them.

    A text is passed over if the ones before it leave no room for it.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.select(F.lower(F.trim(lang_col)).alias("lang"), valid(text_col).alias("text")).where(F.col("lang").isNotNull() & (F.length("text") <= chars))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("size", F.sum(F.length("text")).over(w)).where((F.col("n") <= most) & (F.col("size") <= chars))
    by: dict[str, list[str]] = {}
    for lang, text in rows.select("lang", "text").toLocalIterator():
        by.setdefault(lang, []).append(text)
    return {k: sorted(v) for k, v in by.items()}


def fitted(samples: DataFrame, **more) -> tuple[PPM, dict[str, list[str]]]:
    """The trees and the samples they are fitted on, within all bounds."""
    most, chars = more.pop("most", SAMPLES_PER_LANGUAGE), more.pop("chars", SAMPLE_CHARS)
    while True:
        by = labelled(samples, most=most, chars=chars, **more)
        model = PPM(by)
        if model.bytes <= MODEL_BYTES:
            return model, by
        most, chars = max(1, most // 2), chars // 2


def fit(samples: DataFrame) -> PPM:
    return fitted(samples)[0]


def segments(docs: DataFrame, model: PPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, lang, confidence, sentences, letters): runs of sentences of one language, in order."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: PPM = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                row, seg, lang, conf, count, chars = [], [], [], [], [], []
                sents, owner = [], []
                for r, t in enumerate(piece.column(1).to_pylist()):
                    if t:
                        own = units(t)
                        sents += own
                        owner += [r] * len(own)
                if not sents or not m.langs:
                    continue
                ready = plain_all(sents)
                bits, size, owner = m.score_plain(ready), np.array([letters(s) for s in ready]), np.array(owner)
                bounds = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                for r in np.unique(owner):
                    i = slice(bounds[r], bounds[r + 1])
                    l, c = assign(bits[i])
                    cuts = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]]))
                    for n, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(l)))):
                        row.append(int(r))
                        seg.append(n)
                        lang.append(m.langs[l[a]])
                        conf.append(float(np.average(c[a:b], weights=np.maximum(size[i][a:b], 1))))
                        count.append(int(b - a))
                        chars.append(int(size[i][a:b].sum()))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(seg, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(count, pa.int32()), pa.array(chars, pa.int64())], names=["id", "segment", "lang", "confidence", "sentences", "letters"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), valid(text_col).alias("text")))
    return rows.mapInArrow(run, "id bigint, segment int, lang string, confidence double, sentences int, letters bigint")


def languages_of(segs: DataFrame) -> DataFrame:
    """(id, langs, confidence): the languages of each document, most letters first.

    The main language counts always; another one if it has at least two whole sentences.
    """
    by = segs.groupBy("id", "lang").agg(F.sum("sentences").alias("n"), F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"))
    lists = by.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("letters", "n", "lang", "confidence")), asc=False).alias("l"))
    kept = F.filter("l", lambda x, i: (i == 0) | (x["n"] >= 2))
    return lists.select("id", F.transform(kept, lambda x: x["lang"]).alias("langs"), F.element_at(kept, 1)["confidence"].alias("confidence"))
