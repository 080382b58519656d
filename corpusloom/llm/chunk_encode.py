"""Problem 8: encode a corpus with a public byte-level BPE, each shared chunk once.

A rolling hash over the code points cuts every distinct text into content-defined chunks, so equal
passages of different documents give equal chunks. Digests of all chunks are counted: a chunk that occurs twice is
shared and belongs to its first place. The text it belongs to encodes it, once; the others get its ids by a join on the
digest. Chunks that occur once are encoded where they are, so their texts never travel. Encoding is not
additive at the joins: the pre-tokeniser may match across a cut. So each join is repaired: starting from the last
word of the left chunk that no later text can change, the text around the join is encoded anew, over a growing window, until
a word start of the window falls on a word start of the right chunk. From there on both agree, since the
pre-tokeniser's pattern looks only forward and BPE never crosses words; the ids are those of the whole text, exactly.
Where chunks hold no word start to agree on, they are gathered until they have doubled before they are tried again, so
unbroken text costs a constant factor, not its square.

Distinct texts go through one shuffle and are never written; all else that is shuffled are digests, the ids of shared
chunks and those of repeated texts.

Defined cases: null and empty texts get an empty list; strings that look like special tokens are
plain text; repeated texts are encoded once; texts without any cut or word break of any length are
re-encoded as far as needed. The tokenizer file is a parameter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import pack, rows_of, slices, unpack
from corpusloom.runtime import heavy_keys, join_on_skewed_key, materialise, spread, valid

HASH_SPAN = 16
MEAN_CHUNK = 512
MOST_CHUNK = 4096
#: Bytes after a word that the pre-tokeniser may have looked at before it ended the word (a contraction: 3).
LOOK_AHEAD = 8
#: Bytes of the right chunk that are encoded anew at first.
WINDOW = 64
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut_points(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted chunk bounds over all rows of a batch; row bounds are among them."""
    n = len(cps)
    h = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    span = 1
    while span < HASH_SPAN:  # h[i] depends on the ``span`` code points up to i; each round doubles the span
        h[span:] = h[span:] + h[:-span] * np.uint64(pow(0x100000001B3, span, 1 << 64)) if span < n else h[span:]
        span *= 2
    h ^= h >> np.uint64(32)
    cuts = np.flatnonzero(h % np.uint64(MEAN_CHUNK) == 0) + 1
    if n:  # near its start a row has no full span of its own
        r = rows_of(bounds)[np.minimum(cuts - 1, n - 1)]
        cuts = cuts[cuts - bounds[r] >= HASH_SPAN]
    cuts = np.unique(np.concatenate([cuts, bounds]))
    gap = np.diff(cuts)
    more = (gap - 1) // MOST_CHUNK
    if (more > 0).any():
        extra = np.repeat(cuts[:-1], np.maximum(more, 0)) + MOST_CHUNK * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
        cuts = np.unique(np.concatenate([cuts, extra]))
    return cuts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text key, text) -> (text key, place, digest of the chunk)."""
    for batch in batches:
        for at, n in slices(batch.column(1)):
            chunks, row, place = chunks_of(batch.column(1).slice(at, n))
            if len(row):
                digests = [md5(x.as_buffer()).hexdigest() for x in chunks.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(digests, pa.string())], names=["t", "place", "h"])


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, row, place in the row) of all chunks of some texts, in order."""
    cps, bounds = unpack(texts)
    cuts = cut_points(cps, bounds)
    if len(cuts) < 2:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(bounds, cuts[:-1], side="right") - 1
    return pack(cps, cuts), row, np.arange(len(row)) - np.searchsorted(row, row)


@lru_cache(maxsize=2)
def _load(path: str):
    """The tokenizer and the number of bytes of each of its tokens. One thread each: tasks are what runs side by side."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    size = np.zeros(max(t.get_vocab().values()) + 1, np.int64)
    for token, i in t.get_vocab().items():
        size[i] = len(token)  # each letter of a byte-level token stands for one byte
    return t, size


def _signed(encodings: list) -> list[np.ndarray]:
    """Ids of each encoding; the first token ``i`` of a word is written as ``-1 - i``."""
    out = []
    for e in encodings:
        ids = np.array(e.ids, np.int32)
        out.append(np.where(np.diff(np.array(e.word_ids, np.int64), prepend=-1) != 0, -1 - ids, ids))
    return out


def _encode_shared(path: str):
    """(t, text, n, one, own: [(place, h)]) -> (h, ids) of the shared chunks that belong to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = _load(path)
        for batch in batches:
            for at, n in slices(batch.column("text")):
                part = batch.slice(at, n)
                chunks, row, place = chunks_of(part.column("text"))
                first = np.searchsorted(row, np.arange(n))
                digests, picked = [], []
                for r, own in enumerate(part.column("own").to_pylist()):
                    for x in own or ():
                        digests.append(x["h"])
                        picked.append(int(first[r]) + x["place"])
                made = _signed(t.encode_batch(chunks.take(pa.array(picked, pa.int64())).to_pylist(), add_special_tokens=False))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(made, pa.list_(pa.int32()))], names=["h", "ids"])

    return run


def joined_ids(chunks: list[tuple[bytes, np.ndarray, np.ndarray]], encode, size: np.ndarray) -> np.ndarray:
    """Ids of the whole text from (bytes, ids, first) of its chunks in order.

    ``encode(bytes)`` gives (ids, first) of a piece that begins at a word start.
    """
    out: list[np.ndarray] = []
    carry, tried = b"", 0  # bytes from the last sure word on, and how many of them a try without agreement has seen
    for k, (text, ids, first) in enumerate(chunks):
        last = k == len(chunks) - 1
        if carry and not last and len(carry) + len(text) < 2 * tried:
            carry += text
            continue
        starts = np.concatenate([[0], np.cumsum(size[ids])])[first] if len(ids) else np.zeros(0, np.int64)
        at = 0  # index of the first word of this chunk that is taken over
        if carry:
            at, take = -1, max(WINDOW, len(carry) // 2)
            while True:
                head = head_of(text, take)
                whole = len(head) == len(text)
                wids, wfirst = encode(carry + head)
                wstarts = np.concatenate([[0], np.cumsum(size[wids])])[wfirst] - len(carry)
                ends = np.append(wstarts[1:], len(head))
                sure = ends <= len(head) - LOOK_AHEAD
                if whole and last:
                    sure[:] = True
                place = np.searchsorted(starts, wstarts)
                fit = np.flatnonzero(sure & (wstarts >= 0) & (starts[np.minimum(place, len(starts) - 1)] == wstarts)) if len(starts) else place[:0]
                if len(fit):
                    out.append(wids[: wfirst[fit[0]]])
                    at, tried = int(place[fit[0]]), 0
                    break
                if whole:
                    break
                take *= 4
            if at < 0:  # no agreement inside this chunk: its sure words are settled, the rest goes on
                if last:
                    out.append(wids)
                    break
                keep = int(np.flatnonzero(~sure)[0]) if not sure.all() else len(wfirst)
                if keep < len(wfirst):
                    out.append(wids[: wfirst[keep]])
                    carry = (carry + text)[int(wstarts[keep]) + len(carry) :]
                    tried = len(carry)
                else:
                    out.append(wids)
                    carry, tried = b"", 0
                continue
        if last:
            out.append(ids[first[at] :] if len(first) > at else ids[:0])
            break
        ends = np.append(starts[1:], len(text))
        unsure = np.flatnonzero((ends > len(text) - LOOK_AHEAD) & (np.arange(len(ends)) >= at))
        stop = int(unsure[0]) if len(unsure) else len(first)
        out.append(ids[first[at] : first[stop]] if stop < len(first) else ids[first[at] :])
        carry, tried = text[int(starts[stop]) :] if stop < len(first) else b"", 0
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def head_of(text: bytes, take: int) -> bytes:
    """The first ``take`` bytes, and those that complete the last letter."""
    while take < len(text) and (text[take] & 0xC0) == 0x80:
        take += 1
    return text[:take]


def first_windows(chunks: list[tuple[bytes, np.ndarray, np.ndarray]], size: np.ndarray) -> list[bytes]:
    """What ``joined_ids`` encodes first at each join, as far as no join changes what comes after the next."""
    out = []
    for (text, ids, first), (after, _, _) in zip(chunks, chunks[1:]):
        starts = np.concatenate([[0], np.cumsum(size[ids])])[first]
        ends = np.append(starts[1:], len(text))
        unsure = np.flatnonzero(ends > len(text) - LOOK_AHEAD)
        if len(unsure):
            carry = text[int(starts[unsure[0]]) :]
            out.append(carry + head_of(after, max(WINDOW, len(carry) // 2)))
    return out


def _whole(path: str):
    """(t, text, n, one, given: [(place, ids)]) -> (t, n, one, ids): chunks without given ids are encoded here, then all are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, size = _load(path)

        ready: dict[bytes, np.ndarray] = {}  # first windows, encoded together

        def encode(b: bytes) -> tuple[np.ndarray, np.ndarray]:
            x = ready.get(b)
            if x is None:
                x = _signed([t.encode(b.decode("utf-8"), add_special_tokens=False)])[0]
            return np.where(x < 0, -1 - x, x), np.flatnonzero(x < 0)

        for batch in batches:
            for at, n in slices(batch.column("text")):
                part = batch.slice(at, n)
                chunks, row, place = chunks_of(part.column("text"))
                first = np.searchsorted(row, np.arange(n + 1))
                signed: list = [None] * len(row)
                given = part.column("given")
                for r in np.flatnonzero(np.asarray(given.is_valid())).tolist():
                    own = given[r].values
                    for i, p in enumerate(own.field("place").to_pylist()):
                        signed[int(first[r]) + p] = np.asarray(own.field("ids")[i].values, np.int32)
                left = [i for i, x in enumerate(signed) if x is None]
                texts = chunks.to_pylist()
                for i, x in zip(left, _signed(t.encode_batch([texts[i] for i in left], add_special_tokens=False))):
                    signed[i] = x
                rows = [[(texts[i].encode(), np.where(x < 0, -1 - x, x), np.flatnonzero(x < 0)) for i in range(first[r], first[r + 1]) for x in (signed[i],)] for r in range(n)]
                windows = sorted({w for own in rows for w in first_windows(own, size)})
                ready = dict(zip(windows, _signed(t.encode_batch([w.decode("utf-8") for w in windows], add_special_tokens=False))))
                made = [joined_ids(own, encode, size) for own in rows]
                yield pa.RecordBatch.from_arrays([part.column("t"), part.column("n"), part.column("one"), pa.array(made, pa.list_(pa.int32()))], names=["t", "n", "one", "ids"])

    return run


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(doc_id).alias("doc_id"), valid(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    full = F.col("text").isNotNull() & (F.col("text") != "")
    keyed = rows.select("doc_id", "text", F.when(full, F.md5("text")).alias("t")).where("t IS NOT NULL")
    pieces = materialise(spread(keyed.select("t", "text")).mapInArrow(_cut, "t string, place int, h string"), "pieces")
    place = F.struct("t", "place")
    shared = materialise(pieces.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("uses")).where("first <> last"), "shared")
    heavy = heavy_keys(shared, "h", "uses")
    uses = join_on_skewed_key(pieces, shared.select("h", "first"), "h", heavy).select("t", "place", "h", (place == F.col("first")).alias("own"))
    uses = materialise(uses.groupBy("t", "place", "h", "own").agg(F.count("*").alias("n")).drop("n"), "uses")
    own = uses.where("own").groupBy("t").agg(F.collect_list(F.struct("place", "h")).alias("own"))
    # one query from here on: all its branches read the same shuffle of the texts, which are never written
    texts = keyed.groupBy("t").agg(F.min("text").alias("text"), F.count("*").alias("n"), F.min("doc_id").alias("one"))
    made = texts.join(own, "t").select("t", "text", "n", "one", "own").mapInArrow(_encode_shared(path), "h string, ids array<int>")
    given = join_on_skewed_key(uses.select("t", "place", "h"), made, "h", heavy).groupBy("t").agg(F.collect_list(F.struct("place", "ids")).alias("given"))
    known = texts.join(given, "t", "left").select("t", "text", "n", "one", "given")
    whole = lambda df: df.mapInArrow(_whole(path), f"t string, n bigint, one {kind}, ids array<int>")
    once = whole(known.where("n = 1")).select(F.col("one").alias("doc_id"), "ids")
    often = keyed.groupBy("t").agg(F.count("*").alias("n"))
    copies = join_on_skewed_key(keyed.select("doc_id", "t"), whole(known.where("n > 1")).select("t", "ids"), "t", heavy_keys(often, "t", "n"))
    nothing = rows.where(~F.coalesce(full, F.lit(False))).select("doc_id", F.array().cast("array<int>").alias("ids"))
    return once.unionByName(copies.select("doc_id", "ids")).unionByName(nothing)
