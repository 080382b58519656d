"""Encoding with the fewest tokens, greedy segmentation, decoding and the round-trip check."""

from __future__ import annotations

import re
from collections.abc import Iterable
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusloom.functions import rules
from corpusloom.runtime import valid


class MinTokenEncoder:
    """Fewest tokens by a shortest path from the end of the text to its start.

    A single character costs one token always (its own, else id 0). A longer token replaces it only if
    that is strictly cheaper; of equally cheap longer tokens the shortest is taken. An Aho-Corasick
    automaton over the reversed tokens, run over the reversed text, meets the tokens in just this order:
    by start from the last to the first, and longest first at each start.

    A text falls into parts at the spaces that no token found there reaches across; each part has its shortest path for itself,
    and as most parts are single words, the paths of short parts are remembered.
    """

    #: Parts that are remembered at once, and the most characters of one (a marker alone has about 40).
    PARTS, LONGEST = 200_000, 400

    def __init__(self, ids: dict[str, int]):
        import ahocorasick

        self.known: dict[str, list[int]] = {}
        self.across = ahocorasick.Automaton()
        for token in ids:
            if inner := tuple(k - len(token) + 1 for k in range(1, len(token)) if token[k] == " "):
                self.across.add_word(token, inner)  # its inner spaces, counted from its last character
        self.across.make_automaton()

        self.single = {t: i for t, i in ids.items() if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if len(token) > 1:
                self.automaton.add_word(token[::-1], (len(token), i))
        self.automaton.make_automaton()
        self.long = len(self.automaton) > 0

    def encode(self, text: str) -> list[int]:
        crossed = {end + k for end, inner in self.across.iter(text) for k in inner} if len(self.across) else ()
        out, at, p, known = [], 0, text.find(" ", 1), self.known
        while p >= 0:
            if p not in crossed:
                part = text[at:p]
                out += known.get(part) or self._part(part)
                at = p
            p = text.find(" ", p + 1)
        return out + self._part(text[at:])

    def _part(self, part: str) -> list[int]:
        got = self.known.get(part)
        if got is None:
            got = self._shortest(part)
            if len(part) <= self.LONGEST:
                if len(self.known) >= self.PARTS:
                    self.known.clear()
                self.known[part] = got
        return got

    def _shortest(self, text: str) -> list[int]:
        n = len(text)
        if not n:
            return []
        single, cost, step, token = self.single, [0] * (n + 1), [1] * n, [0] * n
        at, best, length, ident = n - 1, n + 1, 1, 0  # the start being settled and its best longer token
        if self.long:
            for r, (size, i) in self.automaton.iter(text[::-1]):
                here = n - 1 - r
                while at > here:
                    c = cost[at + 1] + 1
                    if best < c:
                        cost[at], step[at], token[at] = best, length, ident
                    else:
                        cost[at], token[at] = c, single.get(text[at], 0)
                    at -= 1
                    best = n + 1
                c = cost[here + size] + 1
                if c <= best:
                    best, length, ident = c, size, i
        while at >= 0:
            c = cost[at + 1] + 1
            if best < c:
                cost[at], step[at], token[at] = best, length, ident
            else:
                cost[at], token[at] = c, single.get(text[at], 0)
            at -= 1
            best = n + 1
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i += step[i]
        return out


def vocabulary_ids(vocabulary: DataFrame | dict[str, int]) -> dict[str, int]:
    """Token to id. A vocabulary is a bounded table (its size is a training parameter)."""
    if isinstance(vocabulary, dict):
        return vocabulary
    return {r["token"]: r["token_id"] for r in vocabulary.select("token", "token_id").orderBy("token_id").collect()}


#: Encoders of this process by their vocabulary's digest; a worker serves many tasks.
_CODERS: dict[str, MinTokenEncoder] = {}


def coder_of(digest: str, ids: dict[str, int]) -> MinTokenEncoder:
    if digest not in _CODERS:
        if len(_CODERS) >= 4:
            _CODERS.clear()
        _CODERS[digest] = MinTokenEncoder(ids)
    return _CODERS[digest]


def _digest(ids: dict[str, int]) -> str:
    return md5(repr(sorted(ids.items())).encode("utf-8", "surrogatepass")).hexdigest()


def _ids_of(texts: pa.Array, coder: MinTokenEncoder) -> pa.ListArray:
    made = [coder.encode(t or "") for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    flat = np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def encoder(vocabulary: DataFrame | dict[str, int]):
    """Column function text -> ids. The automata are built once per worker; null and "" give []."""
    ids = vocabulary_ids(vocabulary)
    digest = _digest(ids)

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(col: pa.Array) -> pa.Array:
        return _ids_of(col, coder_of(digest, ids))

    def apply(text: Column | str) -> Column:
        c = F.col(text) if isinstance(text, str) else text
        if not isinstance(c, Column):
            raise TypeError("a column of texts is needed")
        return run(valid(c))

    return apply


def dense_table(vocabulary: DataFrame | dict[str, int]) -> list[str]:
    """Texts by id; gaps are ""."""
    ids = vocabulary_ids(vocabulary)
    out = [""] * (max(ids.values(), default=-1) + 1)
    for t, i in ids.items():
        if i >= 0:
            out[i] = t
    return out


def decoded(df: DataFrame, vocabulary: DataFrame | dict[str, int], ids: str = "ids", to: str = "text") -> DataFrame:
    """Texts of id arrays; ids outside the table and null ids are skipped. Gathers and joins run on whole Arrow batches."""
    table = dense_table(vocabulary)

    @F.arrow_udf(StringType())
    def run(col: pa.Array) -> pa.Array:
        return _texts_of(col, table)

    return df.withColumn(to, run(F.col(ids)))


def _texts_of(lists: pa.Array, table: list[str]) -> pa.Array:
    tokens = pa.array([*table, ""], pa.string())
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(float)
    fit = np.where((flat >= 0) & (flat < len(table)), flat, len(table)).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    parts = pa.ListArray.from_arrays(pa.array(offsets), tokens.take(pa.array(fit)))
    return pc.binary_join(parts, "")


def coded(lines: DataFrame, vocabulary: DataFrame | dict[str, int], text: str = "text") -> DataFrame:
    """The lines with a text, their ``ids`` and the decoded text ``back``. In one Arrow step: of column functions, Spark would run the encoder once for
    the ids and once more for what is decoded, and what made the texts once more for the filter."""
    ids = vocabulary_ids(vocabulary)
    digest, table = _digest(ids), dense_table(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = coder_of(digest, ids)
        for b in batches:
            b = b.filter(pc.not_equal(b[text], ""))
            made = _ids_of(b[text], coder)
            yield pa.RecordBatch.from_arrays([*b.columns, made, _texts_of(made, table)], names=[*b.schema.names, "ids", "back"])

    schema = StructType([*lines.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("back", StringType())])
    return lines.withColumn(text, valid(text)).mapInArrow(run, schema)


def segment(words: Iterable[str], vocabulary: set[str]) -> list[str]:
    """Units of each word, merging the leftmost neighbours whose join is in the vocabulary until none is."""
    out: list[str] = []
    for w in words:
        cur = re.findall(rules.UNIT, w)
        i = 0
        while i < len(cur) - 1:
            if cur[i] + cur[i + 1] in vocabulary:
                cur[i : i + 2] = [cur[i] + cur[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        out += cur
    return out


def segmented(clauses: DataFrame, vocabulary: set[str]) -> DataFrame:
    """(units, n) of (words, n) clauses; the vocabulary is bounded by the training size and broadcast."""
    held = clauses.sparkSession.sparkContext.broadcast(frozenset(vocabulary))
    cache: dict[str, list[str]] = {}  # of a task, for all its batches

    @F.arrow_udf(ArrayType(StringType()))
    def run(col: pa.Array) -> pa.Array:
        known = held.value

        def one(w: str) -> list[str]:
            got = cache.get(w)
            if got is None:
                if len(cache) > 100_000:
                    cache.clear()
                got = cache[w] = segment([w], known)
            return got

        return pa.array([[u for w in words for u in one(w)] for words in col.to_pylist()], pa.list_(pa.string()))

    return clauses.select(run(F.col("words")).alias("units"), "n")
