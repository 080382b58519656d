"""Problem 3: mix sources to target shares out of fixed-length blocks.

The texts of each source are laid end to end (order: a hash of the row id) and cut into blocks of
``BLOCK`` units, so a block is a list of (row, from, to) pieces. A unit is whatever the rows' ``size`` counts: the ids
of a tokenizer where the payload is an array of ids, characters where it is a text. A mix asks for so many
units of each source; what ``max_repeats`` allows caps it. The output is a row of shards of ``SHARD`` slots. The
number of slots each source gets in a shard is a multinomial draw, conditioned on the totals so that the shares come
out exactly (multivariate hypergeometric). The draws form a tree: a range of shards shares its slots out to its halves, with
a seed made of the mix and the range, so every shard finds its own counts and first slot numbers by one walk from the
root. Tasks do that for their shards; the driver only knows the mixes. Slot ``s`` of a source takes block
``perm(s mod n, epoch s div n)``, a keyed pseudorandom permutation of the source's block numbers, so no block is used a
time more before all others are, and none more than ``max_repeats`` times. Slots and blocks meet in an equi-join on
(source, block), which has no hot key: a block has at most ``max_repeats`` slots.

A source is short of its target if the slots drawn use each of its blocks ``max_repeats`` times and still come to
less than the target.

Defined cases: null texts have size 0; a source without text or with share 0 gets no slot; rows whose
file isn't listed belong to no source and are left out; an empty table makes every reached size 0 and
every positive target short; repeated texts are separate rows and may each be used ``max_repeats`` times.
Ranges of ``EXACT`` slots and more are halved by the normal law with the draw's mean and variance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import materialise

BLOCK = 2048
SHARD = 4096
SEED = 20260101
#: Rows of one running-sum group; groups, not rows, are numbered in one window per source.
GROUP_ROWS = 20_000
#: numpy draws hypergeometric numbers exactly below this population.
EXACT = 500_000_000


def blocks_of(rows: DataFrame) -> DataFrame:
    """(source, block, row_id, lo, hi): pieces of the rows (source, row_id, size) that make up each block.

    The running sum is taken in two steps, inside hash groups and over the groups' totals, so a
    source that holds most of the rows is still spread over all tasks.
    """
    n = rows.count()
    groups = max(1, n // GROUP_ROWS)
    placed = rows.where("size > 0").withColumn("g", F.pmod(F.xxhash64("row_id", F.lit(SEED)), F.lit(groups)))
    inside = Window.partitionBy("source", "g").orderBy(F.xxhash64("row_id", F.lit(SEED + 1)), "row_id")
    placed = placed.withColumn("end_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = placed.groupBy("source", "g").agg(F.sum("size").alias("group_size"))
    before = totals.withColumn("before", F.sum("group_size").over(Window.partitionBy("source").orderBy("g")) - F.col("group_size")).select("source", "g", "before")
    at = placed.join(before, ["source", "g"]).withColumn("start", F.col("before") + F.col("end_in") - F.col("size"))
    first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")
    out = at.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("start"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * BLOCK - F.col("start"))
    return out.select("source", "block", "row_id", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def permuted(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of 0..n-1: a four-round Feistel network over the next even power of two, walked until inside."""
    if n <= 1:
        return np.zeros_like(slot)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    x = once(slot.astype(np.uint64))
    out = x >= np.uint64(n)
    while out.any():
        x[out] = once(x[out])
        out = x >= np.uint64(n)
    return x.astype(np.int64)


def halved(slots: np.ndarray, part: int, seed: list[int]) -> np.ndarray:
    """How many of the slots of each source fall among ``part`` slots drawn from all of them."""
    total = int(slots.sum())
    rng = np.random.default_rng(seed)
    if total < EXACT:
        return rng.multivariate_hypergeometric(slots, part, method="marginals")
    out, left, room = np.zeros_like(slots), total, part
    for k in range(len(slots)):  # one source after the other, each against those after it
        rest = left - int(slots[k])
        mean = room * int(slots[k]) / left if left else 0.0
        sd = (mean * (1 - room / left) * rest / max(1, left - 1)) ** 0.5 if left else 0.0
        out[k] = min(int(slots[k]), room, max(room - rest, round(mean + sd * rng.standard_normal())))
        left, room = rest, room - int(out[k])
    return out


def shard_slots(slots: np.ndarray, no: int, mix: int, shard: int = SHARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first slot number, number of slots) of each source in output shard ``no``, by the walk down the tree of ranges."""
    count, first = slots.astype(np.int64), np.zeros(len(slots), np.int64)
    lo, hi = 0, -(-int(count.sum()) // shard)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = halved(count, min((mid - lo) * shard, int(count.sum())), [seed, mix, lo, hi])
        if no < mid:
            count, hi = left, mid
        else:
            first, count, lo = first + left, count - left, mid
    return first, count


def _slots(shards: DataFrame, mixes: dict[int, np.ndarray], sources: list[str], blocks: np.ndarray) -> DataFrame:
    """(mix_id, source, block, shard, slot) of every slot of the shards (mix_id, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mix, no in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (first, count) in enumerate(zip(*(x.tolist() for x in shard_slots(mixes[mix], no, mix)))):
                    if not count:
                        continue
                    n, s = int(blocks[k]), np.arange(first, first + count)
                    block = np.zeros(count, np.int64)
                    for epoch in np.unique(s // n):
                        own = s // n == epoch
                        block[own] = permuted(s[own] % n, n, SEED + 1000 * mix + 100_000 * k + int(epoch))
                    yield pa.RecordBatch.from_arrays([pa.array([mix] * count, pa.int32()), pa.array([sources[k]] * count), pa.array(block), pa.array([no] * count, pa.int64()), pa.array(s)], names=["mix_id", "source", "block", "shard", "slot"])

    return shards.mapInArrow(run, "mix_id int, source string, block bigint, shard bigint, slot bigint")


class Mixture:
    """Blocks and slots of all wanted mixes.

    ``rows``: (source, row_id, size); ``mixes``: one row per mix with a share column per source,
    ``size_factor`` and ``max_repeats`` (a small table: it is collected).
    """

    def __init__(self, rows: DataFrame, mixes: DataFrame, sources: list[str]):
        self.spark, self.sources = rows.sparkSession, sources
        self.pieces = materialise(blocks_of(rows), "pieces")
        self.blocks = self.pieces.groupBy("source", "block").agg(F.sum(F.col("hi") - F.col("lo")).alias("size"))
        have = {r["source"]: (r["n"], r["size"]) for r in self.blocks.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
        self.have = {s: have.get(s, (0, 0)) for s in sources}
        total = sum(size for _, size in self.have.values())
        self.targets, self.wanted = [], {}
        for m in mixes.orderBy("mix_id").collect():
            slots = []
            for s in sources:
                n, size = self.have[s]
                want = m[s] * m["size_factor"] * total
                # a whole pass over a source is n slots of size / n units each
                slots.append(min(round(want * n / size), n * m["max_repeats"]) if size else 0)
                self.targets.append((m["mix_id"], s, int(size), n, float(want), m["max_repeats"]))
            self.wanted[m["mix_id"]] = np.array(slots, np.int64)

    def slots(self) -> DataFrame:
        """Every slot of every mix with the block it takes."""
        shards = self.spark.createDataFrame([(mix, -(-int(x.sum()) // SHARD)) for mix, x in self.wanted.items()], "mix_id int, shards bigint")
        parts = shards.where("shards > 0").select("mix_id", "shards", F.explode(F.expr("sequence(0L, (shards - 1) div 256)")).alias("part")).repartition("mix_id", "part")
        each = parts.select("mix_id", F.explode(F.expr("sequence(part * 256, least(shards - 1, part * 256 + 255))")).alias("shard"))
        return _slots(each, self.wanted, self.sources, np.array([self.have[s][0] for s in self.sources], np.int64))

    def report(self) -> DataFrame:
        """(mix_id, source, size, target, reached, target_share, reached_share, most_uses, short): what the drawn blocks really add up to."""
        drawn = self.slots().groupBy("mix_id", "source", "block").agg(F.count("*").alias("uses")).join(self.blocks, ["source", "block"])
        reached = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("uses") * F.col("size")).alias("reached"), F.max("uses").alias("most_uses"), F.min("uses").alias("least_uses"), F.count("*").alias("used"))
        wanted = self.spark.createDataFrame(self.targets, "mix_id int, source string, size bigint, blocks bigint, target double, max_repeats int")
        out = wanted.join(reached, ["mix_id", "source"], "left").fillna(0, ["reached", "most_uses", "least_uses", "used"])
        whole = Window.partitionBy("mix_id")
        share = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole))
        spent = (F.col("used") == F.col("blocks")) & ((F.col("least_uses") == F.col("max_repeats")) | (F.col("blocks") == 0))
        return out.select("mix_id", "source", "size", "target", "reached", share("target").alias("target_share"), share("reached").alias("reached_share"), "most_uses", (spent & (F.col("reached") < F.col("target"))).alias("short"))

    def records(self, payload: DataFrame, col: str = "text") -> DataFrame:
        """(mix_id, shard, slot, source, block, row_id, lo, col): the mixed corpus; ``payload``: (row_id, col), a text or an array of ids."""
        used = self.slots().join(self.pieces, ["source", "block"]).join(payload, "row_id")
        cut = "slice" if dict(payload.dtypes)[col].startswith("array") else "substring"
        return used.select("mix_id", "shard", "slot", "source", "block", "row_id", "lo", F.expr(f"{cut}(`{col}`, cast(lo + 1 AS int), cast(hi - lo AS int))").alias(col))
