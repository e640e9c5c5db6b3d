"""Samples of a volume for fits of thousands of steps: drawn by the hash of the voxels' keys, written once, and gone through by passes of many candidates at once.

The sample is a table in the shared folder, in parts by hash: the same rows in the same parts and order however the volume is dealt out. A pass sends one row of sums for each part and
candidate to the driver, which adds them up exactly rounded; no sample comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dropped, written

#: Rows of a part, unless the number of parts is given.
PART_ROWS = 1 << 18
_LOW, _SPAN = -(1 << 63), 1 << 64


@dataclass
class Sample:
    """(part, and the values as doubles) in the shared folder."""

    table: DataFrame
    values: list[str]
    count: int
    parts: int

    def drop(self) -> None:
        dropped(self.table)


def _cut(counts: dict[int, int], most: int) -> tuple[int, int]:
    """The cell in which the ``most``-th row lies, and how many rows lie before it."""
    before = 0
    for cell in sorted(counts):
        if before + counts[cell] >= most:
            return cell, before
        before += counts[cell]
    return max(counts), before - counts[max(counts)]


def draw(samples: DataFrame, values: list[str], key: list[str], most: int, parts: int | None = None) -> Sample:
    """The ``most`` rows without a null or NaN value whose keys have the lowest hashes (all if there are fewer; rows whose hash equals the last one's all come along).

    The last hash is found from counts of 65,536 cells, and of as many inside the cell where it lies; the rows of one of the latter, a handful, come to the driver.
    """
    h = F.xxhash64(*[F.col(c) for c in key], F.lit(31)).alias("h")
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in values]
    rows = samples.where(np.bitwise_and.reduce(np.array(known, object))).select(h, *[F.col(c).cast("double").alias(c) for c in values])
    counts = {r[0]: r[1] for r in rows.groupBy(F.shiftright("h", 48)).count().collect()}
    total, last = sum(counts.values()), -_LOW - 1
    if total > most:
        cell, before = _cut(counts, most)
        rows = written(rows.where(F.col("h") < F.lit(min(-_LOW - 1, (cell + 1) << 48))), "candidates")
        inner = rows.where(F.shiftright("h", 48) == cell)
        fine = {r[0]: r[1] for r in inner.groupBy(F.shiftright("h", 32)).count().collect()}
        finer, more = _cut(fine, most - before)
        last = sorted(r.h for r in inner.where(F.shiftright("h", 32) == finer).select("h").collect())[most - before - more - 1]
    kept = rows.where(F.col("h") <= last)
    number = parts or max(1, -(-min(total, most) // PART_ROWS))
    place = F.floor((F.col("h").cast("double") - float(_LOW)) / float(last - _LOW + 1) * number).cast("int")
    laid = kept.withColumn("part", F.least(F.lit(number - 1), place)).repartitionById(number, F.col("part")).sortWithinPartitions("h", *values)
    table = written(laid.select("part", *values), "sample")
    if total > most:
        dropped(rows)
    return Sample(table, values, table.count() if total > most else total, number)


def summed(sample: Sample, candidates: int, kernel: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Sums over the sample: ``kernel`` gets the values of some rows and gives an array of (candidates, numbers); one pass over the table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            part, columns = b.column(0).to_numpy(), [b.column(k).to_numpy() for k in range(1, b.num_columns)]
            for p in np.unique(part):
                own = part == p
                found[int(p)] = found.get(int(p), 0.0) + kernel(columns if own.all() else [c[own] for c in columns])
        for p, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], ["part", "sums"])

    rows = sample.table.mapInArrow(work, "part int, sums array<double>").collect()
    return np.array([fsum(x) for x in zip(*(r.sums for r in rows), strict=True)]).reshape(candidates, -1) if rows else np.zeros((candidates, 0))


def in_step(climbers: list[Generator], evaluate: Callable[[list], list]) -> list:
    """Runs generators that yield what they want evaluated and return a result: all that are waiting are evaluated in one call."""
    results, waiting = [None] * len(climbers), {}
    for k, c in enumerate(climbers):
        try:
            waiting[k] = next(c)
        except StopIteration as end:
            results[k] = end.value
    while waiting:
        keys = list(waiting)
        for k, answer in zip(keys, evaluate([waiting.pop(k) for k in keys]), strict=True):
            try:
                waiting[k] = climbers[k].send(answer)
            except StopIteration as end:
                results[k] = end.value
    return results
