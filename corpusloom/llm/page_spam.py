"""Problem 10: keyword-stuffed pages and link lists, by robust Mahalanobis distance per language.

One pass over the texts gives each document its language (prediction by partial matching, see
``language_ppm``), its languages by sentence, and six features: share of function words, of links, of tags
and of tokens with digits among all tokens, share of repeated word pairs, and evenness of the words'
distribution. The rows are written once. Over all of them, each language gets medians and median absolute
deviations (spread with a floor), and from values clipped at ``CLIP`` spreads a correlation matrix shrunk towards
the identity. A document's deviation then has a Mahalanobis distance, and a projection on the direction
of spam (fewer function words; more links, tags, digits, repetition; less even). It is spam if both are large.

Defined cases: null, empty and wordless texts without links or tags have no features and are never
spam; a language's statistics are those of its documents and of ``PRIOR_DOCS`` documents of all languages together; a constant
feature keeps the floor as its spread; repeated documents are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.language_ppm import LEAST, assign, bare, fitted, letters, plain_all, units, words
from corpusloom.runtime import materialise, spread, valid

FEATURES = ("func", "link", "tag", "digit", "repeat", "even")
#: Direction of spam for each feature.
DIRECTION = np.array([-1.0, 1.0, 1.0, 0.5, 0.5, -1.0])
FLOOR = np.array([0.05, 0.05, 0.05, 0.05, 0.1, 0.1])
CLIP = 3.0
SHRINK = 0.5
#: So many documents of all languages stand for what is not known yet of one; so many tokens of an ordinary page for what a short page doesn't show.
PRIOR_DOCS = 20
FEW_TOKENS = 10
DISTANCE, PROJECTION = 6.0, 5.3
#: A word is a function word of its language if at least this many of its samples (and this share) hold it.
FUNCTION_ROWS, FUNCTION_SHARE = 2, 0.04

_LINK = re.compile(r"<a\s[^<>]*>[^<>]*</a>|\[[^\[\]\n]*\]\([^()\s]*\)|https?://\S+|www\.\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}(?:/\S*)?(?=[\s,;)|]|$)", re.I)
_TAG = re.compile(r"(?<!\w)#\w+")
_WORD = re.compile(r"[^\W\d_](?:[\w'’̀-ͯ]*\w)?")
_NUMBER = re.compile(r"\d\w*")  # one match a token with digits
_MAY_LINK = re.compile(r"<a\s|\]\(|://|www\.|\.[a-z]{2}", re.I)


def function_words(samples: dict[str, list[str]]) -> dict[str, frozenset[str]]:
    out = {}
    for lang, texts in samples.items():
        df = Counter(w for t in texts for w in {bare(x.lower()) for x in _WORD.findall(t)})
        out[lang] = frozenset(w for w, n in df.items() if n >= max(FUNCTION_ROWS, FUNCTION_SHARE * len(texts)))
    return out


def _word_hashes(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of line breaks before) of the words, between spaces and line breaks, of one text."""
    data = np.frombuffer(joined.encode(), np.uint8)
    inside = data > 32
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = inside & np.concatenate([[True], ~inside[:-1]])
    first, at = np.flatnonzero(new), np.flatnonzero(inside)
    no = np.cumsum(new)[at] - 1
    x = (data[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (at - first[no]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = np.add.reduceat(x ^ (x >> np.uint64(27)), np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]])))
    return h ^ (h >> np.uint64(29)), np.cumsum(data == 10)[first]


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, count) of the distinct hashes of each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[first], np.diff(np.append(first, len(h)))


def batch_features(texts: list[str | None], ready: list[str], owner: np.ndarray, lang: np.ndarray, func: list[np.ndarray]) -> np.ndarray:
    """Features and number of tokens of each text, NaN where there are none.

    ``ready``: the sentences of all texts after ``plain``; ``owner`` and ``lang``: text and language of each; ``func``:
    sorted hashes of the function words by language.
    """
    n = len(texts)
    links, tags, digits = np.zeros(n), np.zeros(n), np.zeros(n)
    for r, t in enumerate(texts):
        if not t:
            continue
        if _MAY_LINK.search(t):
            t, links[r] = _LINK.subn(" ", t)
        if "#" in t:
            t, tags[r] = _TAG.subn(" ", t)
        digits[r] = len(_NUMBER.findall(t))
    h, sentence = _word_hashes(bare("\n".join(ready)))
    doc, of = owner[sentence], lang[sentence]
    hits = np.zeros(len(h), bool)
    for k, known in enumerate(func):
        own = of == k
        if len(known) and own.any():
            hits[own] = np.isin(h[own], known)
    count = np.bincount(doc, minlength=n).astype(float)
    total = count + links + tags
    same = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, _ = _runs(h[same] * np.uint64(0x9E3779B97F4A7C15) + h[same + 1], doc[same])
    of_word, often = _runs(h, doc)
    with np.errstate(divide="ignore", invalid="ignore"):
        repeat = np.where(count > 1, 1 - np.bincount(pairs, minlength=n) / (count - 1), 0.0)
        spread_ = -np.bincount(of_word, weights=often * np.log(often / count[of_word]), minlength=n) / count / np.log(count)
        out = np.column_stack([np.minimum(1.0, np.bincount(doc, weights=hits, minlength=n) / total), links / total, tags / total, np.minimum(1.0, digits / total), repeat, np.where(count > 1, spread_, 1.0), total])
    out[total == 0] = np.nan
    return out


def profiles(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """(id, label, lang, found, func, link, tag, digit, repeat, even, tokens): ``found`` lists (lang, whole sentences, letters, confidence)."""
    model, by = fitted(samples)
    known = function_words(by)
    held = docs.sparkSession.sparkContext.broadcast((model, [np.unique(_word_hashes("\n".join(sorted(known.get(x, ()))))[0]) for x in model.langs]))
    found = pa.struct([("lang", pa.string()), ("sentences", pa.int32()), ("letters", pa.int64()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, func = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = piece.column(2).to_pylist()
                sents, owner = [], []
                for r, t in enumerate(texts):
                    if t:
                        own = units(t)
                        sents += own
                        owner += [r] * len(own)
                ready, owner = plain_all(sents), np.array(owner, np.int64)
                bits = m.score_plain(ready) if sents else np.zeros((0, len(m.langs)))
                size, whole = np.array([letters(s) for s in ready], np.int64), np.array([words(s) >= LEAST for s in ready], bool)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                lang, langs, lists = np.full(len(sents), -1), [], []
                for r in range(len(texts)):
                    i, own = slice(bounds[r], bounds[r + 1]), []
                    if bounds[r + 1] > bounds[r] and m.langs:
                        l, c = assign(bits[i])
                        lang[i] = l
                        for k in sorted(set(l.tolist())):
                            of = l == k
                            w = np.maximum(size[i][of], 1)
                            own.append({"lang": m.langs[k], "sentences": int(whole[i][of].sum()), "letters": int(size[i][of].sum()), "confidence": float(c[of] @ w / w.sum())})
                        own.sort(key=lambda x: (-x["letters"], x["lang"]))
                    langs.append(own[0]["lang"] if own else None)
                    lists.append(own)
                x = batch_features(texts, ready, owner, lang, func)
                cols = [pa.array(x[:, k], pa.float64(), from_pandas=True) for k in range(len(FEATURES) + 1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(langs, pa.string()), pa.array(lists, pa.list_(found)), *cols], names=["id", "label", "lang", "found", *FEATURES, "tokens"])

    label = F.col(label_col) if label_col else F.lit(None)
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), valid(text_col).alias("text")))
    schema = "id bigint, label string, lang string, found array<struct<lang:string,sentences:int,letters:bigint,confidence:double>>, " + ", ".join(f"`{f}` double" for f in (*FEATURES, "tokens"))
    return rows.mapInArrow(run, schema)


class Judge:
    """Robust statistics of each language and of all documents together (key '')."""

    def __init__(self, rows: DataFrame):
        have = rows.where(F.col("func").isNotNull())
        both = have.select(F.explode(F.array(F.lit(""), F.coalesce("lang", F.lit("?")))).alias("g"), *FEATURES)
        mid = {r["g"]: r for r in both.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 10000).alias(f) for f in FEATURES]).collect()}
        self.mid = {g: np.array([r[f] for f in FEATURES]) for g, r in mid.items()}
        if not self.mid:
            self.spread, self.inverse = {}, {}
            return
        # all documents together count as PRIOR_DOCS documents of each language
        own = {g: r["n"] / (r["n"] + PRIOR_DOCS) if g else 1.0 for g, r in mid.items()}
        blend = lambda by: {g: own[g] * x + (1 - own[g]) * by[""] for g, x in by.items()}
        self.mid = blend(self.mid)
        centre = lambda f: F.element_at(F.create_map(*[x for g, v in self.mid.items() for x in (F.lit(g), F.lit(float(v[FEATURES.index(f)])))]), F.col("g"))
        off = both.select("g", *[(F.col(f) - centre(f)).alias(f) for f in FEATURES])
        mad = off.groupBy("g").agg(*[F.percentile_approx(F.abs(f), 0.5, 10000).alias(f) for f in FEATURES]).collect()
        self.spread = blend({r["g"]: np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), FLOOR) for r in mad})
        scale = lambda f: F.element_at(F.create_map(*[x for g, v in self.spread.items() for x in (F.lit(g), F.lit(float(v[FEATURES.index(f)])))]), F.col("g"))
        z = off.select("g", *[F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col(f) / scale(f))).alias(f) for f in FEATURES])
        pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
        corr = {}
        for r in z.groupBy("g").agg(*[F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).collect():
            c = np.zeros((len(FEATURES),) * 2)
            for a, b in pairs:
                i, j = FEATURES.index(a), FEATURES.index(b)
                c[i, j] = c[j, i] = r[f"{a}_{b}"]
            d = np.sqrt(np.maximum(np.diag(c), 1e-6))
            corr[r["g"]] = c / np.outer(d, d)
        self.inverse = {g: np.linalg.inv(SHRINK * np.eye(len(FEATURES)) + (1 - SHRINK) * c) for g, c in blend(corr).items()}

    def score(self, lang: np.ndarray, x: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, projection on the direction of spam) of each row."""
        distance, projection = np.zeros(len(x)), np.zeros(len(x))
        groups = np.array([g if g in self.inverse else "" for g in lang], dtype=object)
        for g in set(groups):
            of = groups == g
            # a share among few tokens says little: deviations of short texts are shrunk
            z = (x[of] - self.mid[g]) / self.spread[g] * (tokens[of] / (tokens[of] + FEW_TOKENS))[:, None]
            inv = self.inverse[g]
            distance[of] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, inv, z), 0))
            projection[of] = z @ DIRECTION / np.linalg.norm(DIRECTION)
        return distance, projection


def judged(rows: DataFrame) -> DataFrame:
    """``profiles`` rows (written once) with ``distance``, ``projection`` and ``spam``."""
    rows = materialise(rows, "profiles")
    held = rows.sparkSession.sparkContext.broadcast(Judge(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge: Judge = held.value
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(f).to_numpy(zero_copy_only=False), float) for f in FEATURES])
            has = ~np.isnan(x[:, 0])
            lang = np.array([v or "" for v in batch.column("lang").to_pylist()], dtype=object)
            d, p = np.zeros(len(x)), np.zeros(len(x))
            if has.any() and judge.mid:
                d[has], p[has] = judge.score(lang[has], x[has], np.asarray(batch.column("tokens").to_numpy(zero_copy_only=False), float)[has])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d), pa.array(p), pa.array((d >= DISTANCE) & (p >= PROJECTION), pa.bool_())], names=[*batch.schema.names, "distance", "projection", "spam"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", distance double, projection double, spam boolean")
