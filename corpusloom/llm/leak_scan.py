"""Problem 9: passages of evaluation items inside documents.

Words (letters, marks, digits; one case, composed) are hashed to 64 bits. Every window of ``WINDOW`` consecutive words,
of items and of documents, gets a SimHash: bit by bit the majority of the window's words, from running sums in packed
counters, so a window costs the same at any length. The fingerprint is cut into ``BLOCKS`` blocks; two fingerprints within
``BLOCKS - 1`` bits share a block (pigeonhole), so look-ups by block find all of them. Candidates are verified by the
weighted similarity of their ``SHINGLE``-word shingles (``least`` or more), and a passage is reported if it then is a run of
equal words. Equal windows have equal fingerprints, so no passage is missed.

Near copies are windows of an item's own length whose weighted shingle similarity with the whole item
is ``least`` or more. No radius of a fingerprint holds all of these, so their candidates come from the
shingles: such a window holds at least ``least`` of the item's shingles, hence one of any
``1 - least`` of them and one more (pigeonhole). Every window of such a document is compared exactly.

The item side is a stated query set. It is held in blocks of at most ``ITEM_WORDS`` words each; one scan of the documents
looks into ``BLOCKS_PER_SCAN`` of them, with the documents' words hashed once. No pair of documents is ever formed and
no item is left out.

Defined cases: null and empty documents and items contain nothing; items or documents of fewer than
``WINDOW`` words cannot share a passage; a document shorter than an item is one window for near copies; a document is reported once per item however often the
passage occurs; equal items are each reported; documents may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import slices
from corpusloom.llm.wordhash import hashed_words
from corpusloom.runtime import spread, valid

WINDOW = 12
SHINGLE = 5
BLOCKS = 4
RADIUS = BLOCKS - 1
#: Most words of items that one broadcast block holds (about 60 bytes a word, so 30 MB).
ITEM_WORDS = 500_000
#: Blocks that a worker holds at once (about 26 MB each with their index).
BLOCKS_PER_SCAN = 4


@lru_cache(maxsize=4)
def _lanes(width: int) -> np.ndarray:
    """For each value of ``64 // width`` bits a 64-bit word with one counter of ``width`` bits for each of them."""
    per = 64 // width
    value = np.arange(1 << per, dtype=np.uint64)
    out = np.zeros(1 << per, np.uint64)
    for j in range(per):
        out |= ((value >> np.uint64(j)) & np.uint64(1)) << np.uint64(width * j)
    return out


def window_prints(words: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of all windows of ``size`` words that lie in one document.

    Several bits are counted at once in the counters of one 64-bit word; the difference of two running sums, modulo
    2^64, is the sum of a window, in which no counter runs over.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(doc[:n] == doc[size - 1 :])
    width = next(w for w in (8, 16, 32) if size < 1 << (w - 1))
    per, lanes, out = 64 // width, _lanes(width), np.zeros(n, np.uint64)
    top = np.uint64(sum(1 << (width * j + width - 1) for j in range(per)))
    more = np.uint64(sum(((1 << (width - 1)) - size // 2 - 1) << (width * j) for j in range(per)))  # lifts a majority into the counter's top bit
    run = np.zeros(len(words) + 1, np.uint64)
    for k in range(0, 64, per):
        np.cumsum(lanes[((words >> np.uint64(k)) & np.uint64((1 << per) - 1)).astype(np.int64)], out=run[1:])
        votes = (run[size:] - run[:-size] + more) & top
        for j in range(per):
            out |= ((votes >> np.uint64(width * j + width - 1)) & np.uint64(1)) << np.uint64(k + j)
    return start, out[start]


class ItemIndex:
    """Fingerprints of all item windows, by block."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, item: np.ndarray, size: int = WINDOW):
        self.ids, self.words, self.item, self.size = ids, words, item, size
        self.start, self.prints = window_prints(words, item, size)
        self.blocks = []
        width = 64 // BLOCKS
        for b in range(BLOCKS):
            part = ((self.prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = np.searchsorted(part[order], np.arange((1 << width) + 1))
            self.blocks.append((order, first))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``prints``, item window) of all pairs within ``RADIUS`` bits."""
        width, found_d, found_i = 64 // BLOCKS, [], []
        for b, (order, first) in enumerate(self.blocks):
            part = ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            lo, n = first[part], first[part + 1] - first[part]
            for at in _pieces(n):
                m = n[at]
                d = np.repeat(np.arange(at.start, at.stop), m)
                i = order[np.repeat(lo[at] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                near = np.bitwise_count(prints[d] ^ self.prints[i]) <= RADIUS
                found_d.append(d[near])
                found_i.append(i[near])
        d, i = np.concatenate(found_d), np.concatenate(found_i)
        both = np.unique(d * np.int64(len(self.prints) + 1) + i)
        return both // (len(self.prints) + 1), both % (len(self.prints) + 1)


def _pieces(n: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Cut so that each piece makes about ``most`` pairs at once; nothing is dropped."""
    run, at = np.cumsum(n), 0
    while at < len(n):
        to = int(np.searchsorted(run, (run[at - 1] if at else 0) + most, side="right"))
        to = max(at + 1, to)
        yield slice(at, to)
        at = to


def shingle_similarity(a: np.ndarray, b: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard of the ``size``-word shingles of each pair of windows (rows); a shingle weighs its count."""
    def shingles(x: np.ndarray) -> np.ndarray:
        h = np.zeros((x.shape[0], x.shape[1] - size + 1), np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[:, k : x.shape[1] - size + 1 + k]
            h ^= h >> np.uint64(29)
        return np.sort(h, axis=1)

    out = np.zeros(len(a))
    sa, sb = shingles(a), shingles(b)
    same = (sa == sb).all(axis=1)
    out[same] = 1.0
    for r in np.flatnonzero(~same):
        ka, ca = np.unique(sa[r], return_counts=True)
        kb, cb = np.unique(sb[r], return_counts=True)
        keys = np.union1d(ka, kb)
        x, y = np.zeros(len(keys), int), np.zeros(len(keys), int)
        x[np.searchsorted(keys, ka)], y[np.searchsorted(keys, kb)] = ca, cb
        out[r] = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    return out


def shingled(words: np.ndarray, row: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all runs of ``size`` words that lie in one row, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]
        h ^= h >> np.uint64(29)
    one = row[:n] == row[size - 1 :]
    return h[one], row[:n][one]


def _at_least(x: float) -> int:
    """The smallest whole number from ``x`` on; a product's rounding error doesn't raise it."""
    return max(1, math.ceil(x - 1e-9))


class NearIndex:
    """Shingles of the items, and for each item so many of them that no near copy is without one."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, item: np.ndarray, least: float):
        if not 0 < least <= 1:
            raise ValueError("least must lie in (0, 1]")
        self.ids, self.least = ids, least
        shingles, of = shingled(words, item)
        long = np.bincount(item, minlength=len(ids)) >= WINDOW
        bounds = np.searchsorted(of, np.arange(len(ids) + 1))
        keys, inverse, often = np.unique(shingles, return_inverse=True, return_counts=True)
        self.sets: list[tuple[np.ndarray, np.ndarray] | None] = []
        anchors, owners = [], []
        for i in range(len(ids)):
            at = slice(bounds[i], bounds[i + 1])
            own, m = inverse[at], bounds[i + 1] - bounds[i]
            if not long[i]:
                self.sets.append(None)
                continue
            self.sets.append(np.unique(shingles[at], return_counts=True))
            rare = own[np.lexsort((own, often[own]))][: m - _at_least(least * m) + 1]
            anchors.append(np.unique(rare))
            owners.append(np.full(len(anchors[-1]), i, np.int64))
        key = keys[np.concatenate(anchors)] if anchors else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.owner = np.concatenate(owners)[order] if anchors else np.zeros(0, np.int64)
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.first = np.append(self.first, len(key))

    def candidates(self, shingles: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) of all documents that hold one of the item's anchors."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == shingles)
        both = np.unique(doc[hit] * np.int64(len(self.keys)) + at[hit])
        doc, at = both // len(self.keys), both % len(self.keys)
        pairs = [np.zeros(0, np.int64)]
        n = self.first[at + 1] - self.first[at]
        for p in _pieces(n):
            m = n[p]
            i = self.owner[np.repeat(self.first[at[p]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            pairs.append(np.unique(np.repeat(doc[p], m) * np.int64(len(self.ids)) + i))
        for x in np.unique(np.concatenate(pairs)).tolist():
            yield divmod(x, len(self.ids))

    def similar(self, item: int, shingles: np.ndarray) -> np.ndarray:
        """Similarities of ``least`` or more of the windows of the item's length in one document's shingles."""
        keys, often = self.sets[item]
        m = int(often.sum())
        size = min(m, len(shingles))
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        held = keys[at] == shingles
        run = np.concatenate([[0], np.cumsum(held)])
        out = []
        for s in np.flatnonzero(run[size:] - run[: len(run) - size] >= _at_least(self.least * (m + size) / (1 + self.least))):
            own = at[s : s + size][held[s : s + size]]
            both = int(np.minimum(np.bincount(own, minlength=len(keys)), often).sum())
            out.append(both / (m + size - both))
        out = np.array(out)
        return out[out >= self.least]


NAMES = ["item_id", "doc_id", "similarity", "windows"]


def near_in(index: NearIndex, words: np.ndarray, doc: np.ndarray, n: int) -> list[tuple[int, int, float, int]]:
    """(item, row, best similarity, windows) of the near copies of the index' items in ``n`` documents."""
    long = np.bincount(doc, minlength=n) >= WINDOW
    shingles, of = shingled(words, doc)
    bounds = np.searchsorted(of, np.arange(n + 1))
    found = []
    for d, i in index.candidates(shingles, of):
        if long[d] and len(sim := index.similar(i, shingles[bounds[d] : bounds[d + 1]])):
            found.append((i, d, float(sim.max()), len(sim)))
    return found


def passages_in(index: ItemIndex, words: np.ndarray, start: np.ndarray, prints: np.ndarray, doc: np.ndarray, least: float) -> list[tuple[int, int, float, int]]:
    """(item, row, similarity, windows) of the runs of equal words among the windows within the radius."""
    if not len(start) or not len(index.prints):
        return []
    d, i = index.candidates(prints)
    span, counts = np.arange(index.size), {}
    for k in range(0, len(d), 200_000):
        dk, ik = d[k : k + 200_000], i[k : k + 200_000]
        a, b = words[start[dk][:, None] + span], index.words[index.start[ik][:, None] + span]
        near = np.flatnonzero(shingle_similarity(a, b) >= least)
        same = near[(a[near] == b[near]).all(axis=1)]
        pairs, often = np.unique(np.stack([index.item[index.start[ik[same]]], doc[start[dk[same]]]]), axis=1, return_counts=True)
        for x, y, m in zip(*pairs.tolist(), often.tolist()):
            counts[x, y] = counts.get((x, y), 0) + m
    return [(x, y, 1.0, m) for (x, y), m in counts.items()]


def _scan(blocks, least: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [ItemIndex(*b.value) if exact else NearIndex(*b.value, least) for b in blocks]
        for batch in batches:
            for at, n in slices(batch.column(1)):
                words, doc, _ = hashed_words(batch.column(1).slice(at, n))
                windows = window_prints(words, doc) if exact else ()
                for index in indexes:
                    found = passages_in(index, words, *windows, doc, least) if exact else near_in(index, words, doc, n)
                    if found:
                        i, d, best, often = zip(*found)
                        keys = batch.column(0).slice(at, n).take(pa.array(d, pa.int64())).cast(pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(index.ids[list(i)], pa.int64()), keys, pa.array(best, pa.float64()), pa.array(often, pa.int64())], names=NAMES)

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_words: int = ITEM_WORDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The item side in blocks of bounded size, streamed to the driver partition by partition."""
    blocks, ids, texts, size = [], [], [], 0

    def close() -> None:
        nonlocal ids, texts, size
        if ids:
            words, item, _ = hashed_words(pa.array(texts, pa.string()))
            blocks.append((np.array(ids, np.int64), words, item))
        ids, texts, size = [], [], 0

    for row in items.select(id_col, valid(text_col).alias(text_col)).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 2 + 1
        if size >= most_words:
            close()
    close()
    return blocks


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: float = 0.8, exact: bool = True) -> DataFrame:
    """(item_id, doc_id, similarity, windows) of all documents with a window of an item.

    ``exact``: ``WINDOW`` words in a row are the same; else all windows of the item's own length whose
    shingle similarity with it is ``least`` or more.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), valid(text).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    out, held = None, []
    for block in item_blocks(items, item_id, text):
        held.append(spark.sparkContext.broadcast(block))
    for k in range(0, len(held), BLOCKS_PER_SCAN):
        part = rows.mapInArrow(_scan(held[k : k + BLOCKS_PER_SCAN], least, exact), "item_id bigint, doc_id bigint, similarity double, windows bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint, similarity double, windows bigint")
    return out.groupBy("item_id", "doc_id").agg(F.max("similarity").alias("similarity"), F.sum("windows").alias("windows"))

