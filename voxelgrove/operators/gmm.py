"""Gaussian mixtures of intensities.

``moments`` makes a step one grouping of all samples. ``fit`` draws up to ``SAMPLE`` voxels by the hash of their keys, writes them once and makes a step one pass over that table: all
attempts that are still under way get their sums from the same pass, and the driver holds their parameters alone. As an attempt may take thousands of steps, those between its first and its last
ones run, each attempt in a task of its own, on ``CELLS`` cells of the sample with the exact count, sum and sum of squares of each: a fixed size, whatever the sample's. Passes over the sample itself
begin and end a fit, so where it ends is decided by the sample.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass
from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import Sample, draw, in_step, summed

#: What a sample without any density is charged.
TINY = 2.2250738585072014e-308
#: Voxels that the fit is made from at most, attempts, steps of one, and the relative change of the likelihood at which one ends.
SAMPLE = 10_000_000
ATTEMPTS, ITERATIONS, TOLERANCE = 10, 4000, 1e-9
#: Steps before any is extrapolated, and exact steps at either end of an attempt.
PLAIN_STEPS = 12
CELLS = 1 << 16


@dataclass
class Mixture:
    weights: list[float]
    means: list[float]
    sigmas: list[float]
    nll: float = float("nan")

    def densities(self, x: Column) -> list[Column]:
        return [F.lit(w / (sqrt(2 * pi) * s)) * F.exp(-0.5 * (x - m) * (x - m) / F.lit(s * s)) for w, m, s in zip(self.weights, self.means, self.sigmas, strict=True)]


def moments(samples: DataFrame, mixture: Mixture, value: str = "u") -> DataFrame:
    """One row: w_k, s1_k and s2_k of each cluster (sums of shares, times x, times x squared), and nll."""
    x, k = F.col(value), len(mixture.means)
    d = samples.select(x.alias("x"), F.array(*mixture.densities(x)).alias("d"))
    d = d.withColumn("sum", F.aggregate("d", F.lit(0.0), lambda a, y: a + y))
    share = [F.when(F.col("sum") > 0, F.col("d")[i] / F.nullif(F.col("sum"), F.lit(0.0))).otherwise(1.0 / k) for i in range(k)]
    sums = [F.sum(g * p).alias(f"{n}_{i}") for i, g in enumerate(share) for n, p in (("w", F.lit(1.0)), ("s1", F.col("x")), ("s2", F.col("x") * F.col("x")))]
    return d.agg(*sums, F.sum(-F.log(F.when(F.col("sum") > 0, F.col("sum")).otherwise(TINY))).alias("nll"))


def assign(samples: DataFrame, mixture: Mixture, value: str = "u") -> DataFrame:
    """Adds cluster: the one of the highest density, the first of equal ones."""
    d = F.array(*mixture.densities(F.col(value)))
    best = F.array_max(F.transform(d, lambda y, k: F.struct(y.alias("d"), (-k).alias("k"))))
    return samples.withColumn("cluster", -best["k"])


def sums(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same sums as ``moments`` of an array: w, s1 and s2 by cluster, and nll."""
    d = np.stack([w / (sqrt(2 * pi) * s) * np.exp(-0.5 * (x - a) ** 2 / (s * s)) for w, a, s in zip(m.weights, m.means, m.sigmas, strict=True)])
    total = d.sum(axis=0)
    share = np.where(total > 0, d / np.where(total > 0, total, 1.0), 1.0 / len(d))
    return share.sum(axis=1), share @ x, share @ (x * x), float(-np.log(np.where(total > 0, total, TINY)).sum())


def next_mixture(m: Mixture, n: int, w: np.ndarray, s1: np.ndarray, s2: np.ndarray, wide: float) -> Mixture:
    """The mixture whose weights, means and deviations are those of the shares.

    A cluster without a share worth counting keeps its mean and is set wide; one that has shrunk to a point is set wide and takes an equal part of the weight from the others.
    """
    k = len(w)
    held = w > max(0.0, min(m.weights) * 1e-9)
    safe = np.where(held, w, 1.0)
    means = np.where(held, s1 / safe, m.means)
    sigmas = np.where(held, np.sqrt(np.abs(s2 / safe - means**2)), wide)
    weights = w / n
    weights = weights / weights.sum()
    for point in np.flatnonzero(sigmas < 1e-12):
        sigmas[point] = wide
        weights *= 1 - 1 / k
        weights[point] = 1 / k
        weights /= weights.sum()
    return Mixture(weights.tolist(), means.tolist(), sigmas.tolist())


def passed(sample: Sample, mixtures: list[Mixture]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """``sums`` for each mixture over the whole sample, in one pass."""
    k = len(mixtures[0].means)

    def kernel(columns: list[np.ndarray]) -> np.ndarray:
        rows = []
        for m in mixtures:
            w, s1, s2, nll = sums(columns[0], m)
            rows.append(np.concatenate([w, s1, s2, [nll]]))
        return np.array(rows)

    return [(x[:k], x[k : 2 * k], x[2 * k : 3 * k], float(x[-1])) for x in summed(sample, len(mixtures), kernel)]


def begin(sample: Sample, centers: list[float]) -> tuple[Mixture, float]:
    """Equal weights at the given centres with the deviations of the samples nearest to each; and half the samples' range."""
    c = np.array(centers, float)

    def kernel(columns: list[np.ndarray]) -> np.ndarray:
        x = columns[0]
        nearest = np.abs(x[:, None] - c).argmin(axis=1)
        return np.stack([np.bincount(nearest, minlength=len(c)).astype(float), np.bincount(nearest, (x - c[nearest]) ** 2, len(c))])

    count, square = summed(sample, 2, kernel)
    ends = sample.table.agg(F.min(sample.values[0]).alias("lo"), F.max(sample.values[0]).alias("hi")).first()
    wide = (ends.hi - ends.lo) / 2 or 1.0
    spread = np.sqrt(square / np.maximum(1, count))
    return Mixture([1 / len(c)] * len(c), c.tolist(), np.where(spread > 0, spread, wide).tolist()), wide


def _numbers(m: Mixture) -> np.ndarray | None:
    """Unbounded numbers for a mixture, if it has them."""
    w, s = np.array(m.weights), np.array(m.sigmas)
    return np.concatenate([np.log(w), m.means, np.log(s)]) if (w > 0).all() and (s > 0).all() else None


def _mixture(x: np.ndarray) -> Mixture:
    w, means, s = np.split(x, 3)
    w = np.exp(w - w.max())
    return Mixture((w / w.sum()).tolist(), means.tolist(), np.exp(s).tolist())


def _leap(a: Mixture, b: Mixture, c: Mixture) -> Mixture | None:
    """Where three mixtures, each a step after the other, seem to lead: squared extrapolation, whose length is that of the first step over its change."""
    x, y, z = _numbers(a), _numbers(b), _numbers(c)
    if x is None or y is None or z is None:
        return None
    r, v = y - x, (z - y) - (y - x)
    bend = float(np.linalg.norm(v))
    if not bend:
        return None
    length = max(1.0, float(np.linalg.norm(r)) / bend)
    far = x + 2 * length * r + length * length * v
    return _mixture(far) if length > 1 and np.isfinite(far).all() and np.abs(far).max() < 500 else None


def climb(m: Mixture, n: int, wide: float, iterations: int, tolerance: float) -> Generator[Mixture, tuple, tuple[Mixture, int]]:
    """Steps of expectation and maximisation: yields a mixture, is sent its sums, and returns the last mixture and how many steps it took.

    After ``PLAIN_STEPS`` steps every pair of them is followed by a leap ahead; one that makes the likelihood worse is taken back. It ends when a step, from anywhere but a leap, changes the
    likelihood by less than the tolerance, so an end is one of plain steps too.
    """
    before, trail, safe = None, [m], None
    for step in range(1, iterations + 1):
        *parts, nll = yield m
        if safe is not None:
            back, was = safe
            safe = None
            if not nll <= was:
                # The leap led astray: go on from where it began.
                m, before, trail = back, None, [back]
                continue
        elif before is not None and abs(before - nll) < tolerance * abs(nll):
            m = next_mixture(m, n, *parts, wide)
            m.nll = nll
            return m, step
        after = next_mixture(m, n, *parts, wide)
        after.nll = nll
        trail, before, m = [*trail, after], nll, after
        if step >= PLAIN_STEPS and len(trail) >= 3 and step < iterations:
            ahead = _leap(*trail[-3:])
            if ahead is not None:
                safe, before = (after, nll), None
                m = ahead
            trail = [m]
    return m, iterations


def cells_of(sample: Sample) -> np.ndarray:
    """(count, sum, sum of squares) of each cell of the sample's range that has values: three numbers for each of at most ``CELLS`` cells."""
    x = F.col(sample.values[0])
    ends = sample.table.agg(F.min(x), F.max(x)).first()
    cell = F.least(F.lit(CELLS - 1), F.floor((x - F.lit(ends[0])) / F.lit((ends[1] - ends[0]) or 1.0) * CELLS))
    found = sample.table.groupBy(cell.alias("cell")).agg(F.count("*").cast("double"), F.sum(x), F.sum(x * x)).toArrow()
    columns = [c.to_numpy() for c in found.columns]
    return np.array(columns[1:])[:, np.argsort(columns[0])]


def sums_of_cells(cells: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``sums`` with every value's share that of its cell's mean."""
    n, s1, s2 = cells
    x = s1 / n
    d = np.stack([w / (sqrt(2 * pi) * s) * np.exp(-0.5 * (x - a) ** 2 / (s * s)) for w, a, s in zip(m.weights, m.means, m.sigmas, strict=True)])
    total = d.sum(axis=0)
    share = np.where(total > 0, d / np.where(total > 0, total, 1.0), 1.0 / len(d))
    return share @ n, share @ s1, share @ s2, float(-np.log(np.where(total > 0, total, TINY)) @ n)


def climbed(sample: Sample, cells: np.ndarray, starts: list[Mixture], wide: float, iterations: int, tolerance: float) -> list[tuple[Mixture, int]]:
    """Each attempt on the cells, in a task of its own."""
    spark, n = sample.table.sparkSession, sample.count
    shared = spark.sparkContext.broadcast(cells)
    rows = spark.createDataFrame([(k, m.weights, m.means, m.sigmas) for k, m in enumerate(starts)], "attempt int, weights array<double>, means array<double>, sigmas array<double>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                m, steps = in_step([climb(Mixture(row["weights"], row["means"], row["sigmas"]), n, wide, iterations, tolerance)], lambda wanted: [sums_of_cells(shared.value, x) for x in wanted])[0]
                yield pa.RecordBatch.from_pylist([{"attempt": row["attempt"], "weights": m.weights, "means": m.means, "sigmas": m.sigmas, "steps": steps}], pa.schema([b.schema.field(0), *[pa.field(c, pa.list_(pa.float64())) for c in ("weights", "means", "sigmas")], pa.field("steps", pa.int32())]))

    found = rows.repartitionById(len(starts), F.col("attempt")).mapInArrow(work, "attempt int, weights array<double>, means array<double>, sigmas array<double>, steps int").collect()
    shared.unpersist()
    return [(Mixture(r.weights, r.means, r.sigmas), r.steps) for r in sorted(found)]


def fit_attempts(sample: Sample, centers: list[float], attempts: int = ATTEMPTS, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, seed: int = 0) -> list[tuple[Mixture, int]]:
    """(mixture, steps) of each attempt: the first from the centres, the others, side by side, from where it ended with each centre moved by up to a quarter of the samples' range."""
    m, wide = begin(sample, centers)
    evaluate = lambda wanted: passed(sample, wanted)
    exact = lambda starts, most: in_step([climb(x, sample.count, wide, most, tolerance) for x in starts], evaluate)
    cells = None

    def ascend(starts: list[Mixture]) -> list[tuple[Mixture, int]]:
        nonlocal cells
        opening = exact(starts, min(iterations, PLAIN_STEPS))
        if iterations <= PLAIN_STEPS or all(n < PLAIN_STEPS for _, n in opening):
            return opening
        cells = cells_of(sample) if cells is None else cells
        middle = climbed(sample, cells, [x for x, _ in opening], wide, max(1, iterations - 2 * PLAIN_STEPS), tolerance)
        closing = exact([x for x, _ in middle], PLAIN_STEPS)
        return [(x, a + b + c) for (x, c), (_, b), (_, a) in zip(closing, middle, opening, strict=True)]

    first = ascend([m])
    base, rng = first[0][0], np.random.default_rng(seed)
    moved = [Mixture(base.weights, [a + float(rng.uniform(-wide / 2, wide / 2)) for a in base.means], base.sigmas) for _ in range(attempts - 1)]
    return first + (ascend(moved) if moved else [])


def drawn(samples: DataFrame, value: str = "u", key: tuple[str, ...] | None = None, most: int = SAMPLE) -> Sample:
    """Raises ValueError if there is no sample. ``key``: what tells the samples apart, the voxel's place if None (or the value, where there is no place)."""
    found = draw(samples, [value], list(key or [c for c in ("n", "row", "col") if c in samples.columns] or [value]), most)
    if not found.count:
        raise ValueError("there is no sample to fit a mixture to")
    return found


def fit(samples: DataFrame, centers: list[float], value: str = "u", key: tuple[str, ...] | None = None, attempts: int = ATTEMPTS, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, seed: int = 0, most: int = SAMPLE) -> Mixture:
    """The likeliest mixture of the attempts, with a cluster for each centre."""
    sample = drawn(samples, value, key, most)
    found = fit_attempts(sample, centers, attempts, iterations, tolerance, seed)
    sample.drop()
    return min((m for m, _ in found), key=lambda m: m.nll)
