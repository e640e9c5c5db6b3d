"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries; records are range-partitioned and overfull ranges subdivided.

The key of a record is (hash of its text, hash of its id), so copies of a text are neighbours. Boundaries lie between texts, so a group of copies
stays in one range and one shard, unless it alone overfills a shard: then boundaries on the second part of the key subdivide it. The ranges,
whose exact sizes are counted, are dealt to the shards largest first.

The driver sees only samples (``SAMPLES_PER_RANGE`` a range) and one row of totals for each range. There are at most ``RANGES`` ranges to begin with, and twice as many once
overfull ones are subdivided; beyond ``MOST_RANGES`` the operator raises.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

RANGES_PER_SHARD = 256
RANGE_BYTES = 256 << 20
RANGES = 1 << 16
MOST_RANGES = 1 << 18
SAMPLES_PER_RANGE = 24
#: A range with more than one key is overfull beyond so many times the size aimed at, and is subdivided until none is.
OVERFULL = 3.0
LOW = -(1 << 63)
HIGH = (1 << 63) - 1

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({"_h": F.xxhash64(whole), "_s": F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit(1)), "size": (F.octet_length(whole) + 1).cast("long")})


class Sample(NamedTuple):
    """Draws in order of the key (h, s), with how often each was drawn."""

    h: np.ndarray
    s: np.ndarray
    weight: np.ndarray

    def between(self, a: tuple[int, int], b: tuple[int, int]) -> Sample:
        """Those of keys from ``a`` on and before ``b``."""
        low, high = (self._place(k) for k in (a, b))
        return Sample(*(x[low:high] for x in self))

    def _place(self, key: tuple[int, int]) -> int:
        low, high = (int(np.searchsorted(self.h, key[0], side)) for side in ("left", "right"))
        return low + int(np.searchsorted(self.s[low:high], key[1]))


def _sample(keys: DataFrame, total: int, draws: int, seed: int) -> Sample:
    """About ``draws`` size-weighted draws; the same for the same rows and seed. They come as Arrow columns, 24 bytes each."""
    share = F.col("size") * F.lit(draws / max(1, total))
    chance = F.pmod(F.xxhash64("_h", "_s", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.withColumn("_w", (F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("long")).where("_w > 0")
    h, s, w = (c.to_numpy() for c in drawn.groupBy("_h", "_s").agg(F.sum("_w").alias("_w")).toArrow().columns)
    order = np.lexsort((s, h))
    return Sample(h[order], s[order], w[order])


def _splitters(sample: Sample, ranges: int) -> set[tuple[int, int]]:
    """Quantile boundaries, each the first key of a range. One text that spans several is fenced off and split by the second part of its key; else a boundary moves before the text it falls in."""
    seen = np.cumsum(sample.weight)
    if not len(seen):
        return set()
    at = np.searchsorted(seen, np.arange(1, ranges) * (int(seen[-1]) / ranges))
    out = list(zip(sample.h[at].tolist(), sample.s[at].tolist(), strict=True))
    often = {h for (h, _), (g, _) in zip(out, out[1:], strict=False) if h == g}
    found = {(h, s if h in often else LOW) for h, s in out}
    for h in often:
        found |= {(h, LOW)} | ({(h + 1, LOW)} if h < HIGH else set())
    return found


def _range_table(spark, splitters: list[tuple[int, int]], shard_of: dict[int, tuple[int, int]] | None = None, only: set[int] | None = None) -> DataFrame:
    """A row for each range, or those of ``only``, and each of the 4096 leading-bit buckets of h that it meets: at most splitters + 4096 rows, so it may be broadcast."""
    starts = [(LOW, LOW), *splitters]
    ends = [*splitters, (HIGH, HIGH)]
    rows = []
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if only is not None and k not in only:
            continue
        shard, base = (shard_of or {}).get(k, (0, 0))
        rows += [(c, a[0], a[1], b[0], b[1], k == len(starts) - 1, k, shard, base) for c in range(a[0] >> 52, (b[0] >> 52) + 1)]
    return spark.createDataFrame(rows, "_c int, _ah long, _as long, _bh long, _bs long, _last boolean, _range int, shard int, _base long")


def _ranged(keys: DataFrame, table: DataFrame) -> DataFrame:
    k, t = keys.withColumn("_c0", F.shiftright("_h", 52).cast("int")), F.broadcast(table)
    from_start = (F.col("_h") > F.col("_ah")) | ((F.col("_h") == F.col("_ah")) & (F.col("_s") >= F.col("_as")))
    to_end = F.col("_last") | (F.col("_h") < F.col("_bh")) | ((F.col("_h") == F.col("_bh")) & (F.col("_s") < F.col("_bs")))
    return k.join(t, (F.col("_c0") == F.col("_c")) & from_start & to_end)


def _deal(splitters: list[tuple[int, int]], totals: dict[int, tuple[int, int]], shards: int) -> dict[int, tuple[int, int]]:
    """range -> (shard, slot of its first row): largest first to the emptiest shard; the ranges of one text go together if a shard can hold them."""
    target = sum(b for b, _ in totals.values()) / shards
    starts = [(LOW, LOW), *splitters]
    texts: dict[int, list[int]] = {}
    for k in totals:
        alone = k > 0 and k < len(starts) - 1 and starts[k][0] == starts[k + 1][0] or k > 0 and starts[k][1] != LOW
        texts.setdefault(starts[k][0] if alone else -2 * (1 << 63) - k, []).append(k)
    units = []
    for ranges in texts.values():
        size = sum(totals[k][0] for k in ranges)
        units += [(size, ranges)] if size <= target else [(totals[k][0], [k]) for k in ranges]
    heap = [(0, s) for s in range(shards)]
    of: dict[int, int] = {}
    for size, ranges in sorted(units, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        of |= dict.fromkeys(ranges, s)
        heapq.heappush(heap, (load + size, s))
    out, rows = {}, [0] * shards
    for k in sorted(of):
        out[k] = (of[k], rows[of[k]])
        rows[of[k]] += totals[k][1]
    return out


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with size (bytes of the text plus 1), text_crc32, law ("bytes"), shard, slot (its place in the shard, from 0 without gaps) and grown_shard (null).

    Defined cases: a null text counts as an empty one (size 1, crc 0); a null id is a key like another; rows that repeat get slots of their own, side by side in
    one shard; an empty table stays empty; columns of ``docs`` named like an added one are replaced. Shards may stay empty when there are fewer texts than shards.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    keys = written(_keyed(docs, text, doc_id).select("_h", "_s", "size"), "shard_keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = min(RANGES, max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES)))
    splitters = _splitters(_sample(keys, total, ranges * SAMPLES_PER_RANGE, 7), ranges)
    aim, seed = total / ranges, 7
    while True:
        at = sorted(splitters)
        key = F.struct("_h", "_s")
        found = _ranged(keys, _range_table(spark, at)).groupBy("_range").agg(F.sum("size"), F.count("*"), F.min(key), F.max(key), F.max_by(F.col("_h"), F.struct("size", "_h"))).collect()
        totals = {r[0]: (r[1], r[2]) for r in found}
        # Rows of one key are equal in text and id; such a range can't be cut and stays whole.
        over = {r[0]: (tuple(r[4]), r[5]) for r in found if r[1] > OVERFULL * aim and r[3] != r[4]}
        if not over:
            break
        parts = {k: max(2, round(totals[k][0] / max(1.0, aim))) for k in over}
        inside = _ranged(keys, _range_table(spark, at, only=set(over))).select("_h", "_s", "size")
        seed += 1
        drawn = _sample(inside, sum(totals[k][0] for k in over), sum(parts.values()) * SAMPLES_PER_RANGE, seed)
        edges = [(LOW, LOW), *at, (HIGH, HIGH)]
        for k, (last, heaviest) in over.items():
            # The text of the largest record is fenced off. The last key can always be parted from the others, so each round gets on.
            fresh = _splitters(drawn.between(edges[k], edges[k + 1]), parts[k]) | {(heaviest, LOW)} | ({(heaviest + 1, LOW)} if heaviest < HIGH else set())
            splitters |= (fresh - splitters) or {last}
        if len(splitters) > MOST_RANGES:
            raise ValueError(f"{len(splitters)} ranges, more than {MOST_RANGES}: the records are too uneven for {shards} shards")
    table = _range_table(spark, at, _deal(at, totals, shards))
    placed = _ranged(_keyed(docs, text, doc_id), table)
    order = Window.partitionBy("_range").orderBy("_h", "_s", F.col(f"`{doc_id}`"))
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "size",
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_base") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` in 8 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select("doc_id", *ADDED)
