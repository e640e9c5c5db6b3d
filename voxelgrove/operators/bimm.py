"""Blurred-interface mixtures on intensity and gradient magnitude: densities as column expressions, masses of the observed window, maximum likelihood.

The error function depends on the quadrature nodes only, never on a voxel, so nodes are constants of the expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import cache
from math import erf, exp, expm1, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import Sample, draw, in_step, summed

NODES = 80


@dataclass
class Theta:
    """weights: of the phases, then of the pairs i < j."""

    weights: list[float]
    peaks: list[float]
    sigma_n: float
    sigma_b: float
    ds: float
    rho: float

    @property
    def pairs(self) -> list[tuple[int, int]]:
        k = len(self.peaks)
        return [(i, j) for i in range(k - 1) for j in range(i + 1, k)]


@cache
def _rule(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on -1..1."""
    return np.polynomial.legendre.leggauss(count)


def nodes(t: Theta, i: int, j: int, count: int = NODES) -> list[tuple[float, float, float]]:
    """(intensity, gradient, weight) along the interface of two phases, the weights summing to 2 ds."""
    x, w = _rule(count)
    a, b = t.peaks[i], t.peaks[j]
    return [(a + 0.5 * (b - a) * (1 + erf(s / sqrt(2))), abs(b - a) / (sqrt(2 * pi) * t.sigma_b) * exp(-s * s / 2), float(c * t.ds)) for s, c in zip(x * t.ds, w, strict=True)]


def _node_column(rows: list[tuple[float, float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("i"), F.lit(g).alias("g"), F.lit(w).alias("w")) for a, g, w in rows])


def _total(col: Column, f) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + f(x))


def pure_density(u: Column, v: Column, t: Theta, i: int) -> Column:
    s2 = t.sigma_n**2
    c = 2 * sqrt(2) / pi / (s2 * s2 * (1 - t.rho) ** 1.5)
    return F.lit(c) * v * v * F.exp(-0.5 * (u - t.peaks[i]) * (u - t.peaks[i]) / s2 - v * v / (s2 * (1 - t.rho)))


def interface_density(u: Column, v: Column, t: Theta, i: int, j: int, count: int = NODES) -> Column:
    s2 = t.sigma_n**2
    a = s2 * (1 - t.rho)
    c = 1 / (2 * sqrt(2 * pi) * pi**0.5) * v / F.lit(t.ds * t.sigma_n * sqrt(a))
    if abs(t.peaks[i] - t.peaks[j]) <= 1e-9:
        return c * F.lit(2 * t.ds) * F.exp(-0.5 * (u - t.peaks[i]) * (u - t.peaks[i]) / s2 - v * v / a) * 4 * v / a
    return c * _total(_node_column(nodes(t, i, j, count)), lambda x: x["w"] * F.exp(-0.5 * (u - x["i"]) * (u - x["i"]) / s2 - (v - x["g"]) * (v - x["g"]) / a) * -F.expm1(-4 * v * x["g"] / a) / x["g"])


def density(u: Column, v: Column, t: Theta, count: int = NODES) -> Column:
    k = len(t.peaks)
    parts = [F.lit(t.weights[i]) * pure_density(u, v, t, i) for i in range(k)]
    parts += [F.lit(t.weights[k + p]) * interface_density(u, v, t, i, j, count) for p, (i, j) in enumerate(t.pairs)]
    return sum(parts[1:], parts[0])


def pure_marginal(u: Column, t: Theta, i: int) -> Column:
    return F.lit(1 / (sqrt(2 * pi) * t.sigma_n)) * F.exp(-(u - t.peaks[i]) * (u - t.peaks[i]) / (2 * t.sigma_n**2))


def interface_marginal(u: Column, t: Theta, i: int, j: int, count: int = NODES) -> Column:
    return F.lit(1 / (sqrt(2 * pi) * 2 * t.ds * t.sigma_n)) * _total(_node_column(nodes(t, i, j, count)), lambda x: x["w"] * F.exp(-(u - x["i"]) * (u - x["i"]) / (2 * t.sigma_n**2)))


def marginal(u: Column, t: Theta, count: int = NODES) -> Column:
    k = len(t.peaks)
    parts = [F.lit(t.weights[i]) * pure_marginal(u, t, i) for i in range(k)]
    parts += [F.lit(t.weights[k + p]) * interface_marginal(u, t, i, j, count) for p, (i, j) in enumerate(t.pairs)]
    return sum(parts[1:], parts[0])


def pure_mass(t: Theta, i: int, lu: float, hu: float, hv: float) -> float:
    """What the window lu..hu, 0..hv holds of a phase."""
    a, s = sqrt(t.sigma_n**2 * (1 - t.rho)), sqrt(2) * t.sigma_n
    return (erf((hu - t.peaks[i]) / s) - erf((lu - t.peaks[i]) / s)) * (0.5 * erf(hv / a) - hv * exp(-((hv / a) ** 2)) / a / sqrt(pi))


def interface_mass(t: Theta, i: int, j: int, lu: float, hu: float, hv: float, count: int = NODES) -> float:
    a, s = sqrt(t.sigma_n**2 * (1 - t.rho)), sqrt(2) * t.sigma_n
    h, out = hv / a, 0.0
    for level, gradient, w in nodes(t, i, j, count):
        g = gradient / a
        z = 4 * g * h
        ratio = -expm1(-z) / z if z else 1.0
        twice = erf(g + h) - erf(g - h) - 4 * h / sqrt(pi) * exp(-((g - h) ** 2)) * ratio
        out += w * twice * (erf((hu - level) / s) - erf((lu - level) / s))
    return out / (8 * t.ds)


def total_mass(t: Theta, lu: float, hu: float, hv: float, count: int = NODES) -> float:
    k = len(t.peaks)
    pure = sum(t.weights[i] * pure_mass(t, i, lu, hu, hv) for i in range(k))
    return pure + sum(t.weights[k + p] * interface_mass(t, i, j, lu, hu, hv, count) for p, (i, j) in enumerate(t.pairs))


def negative_log_likelihood(samples: DataFrame, t: Theta, window: tuple[float, float, float], count: int = NODES) -> DataFrame:
    """(n, nll): the mean over the samples, the density being that inside the window."""
    z = log(total_mass(t, *window, count))
    return samples.agg(F.count("*").alias("n"), (F.avg(-F.log(density(F.col("u"), F.col("v"), t, count))) + F.lit(z)).alias("nll"))


def eligible(uv: DataFrame, lu: float, hu: float, hv: float) -> DataFrame:
    return uv.where((F.col("v") > 0) & (F.col("v") <= hv) & F.col("u").between(lu, hu))


def component_tables(spark, t: Theta, lo: float, hi: float, steps: int = 512, count: int = NODES) -> DataFrame:
    """(component, u, pdf) at steps + 1 places: the whole density over u, each phase's and each interface's part."""
    u = F.lit(lo) + F.col("id") * F.lit((hi - lo) / steps)
    grid = spark.range(steps + 1).select(u.alias("u"))
    k = len(t.peaks)
    parts = [("full", marginal(F.col("u"), t, count))]
    parts += [(f"{i:02d}", F.lit(t.weights[i]) * pure_marginal(F.col("u"), t, i)) for i in range(k)]
    parts += [(f"{i:02d}-{j:02d}", F.lit(t.weights[k + p]) * interface_marginal(F.col("u"), t, i, j, count)) for p, (i, j) in enumerate(t.pairs)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), c.alias("pdf")) for n, c in parts]))
    return grid.select("u", each.alias("x")).select("x.component", "u", "x.pdf")


#: The ranges that the parameters are kept in (logarithms of the widths).
LIMITS = {"weight": (-4.6, 4.6), "peak": (0.0, 1.0), "sigma_n": (log(1e-3), log(2.0)), "sigma_b": (log(0.1), log(10.0)), "rho": (0.0, 0.999)}


def sigmoid(x: float, lo: float, hi: float) -> float:
    return (hi - lo) / (1 + exp(-max(-700.0, min(700.0, x)))) + lo


def inverse_sigmoid(r: float, lo: float, hi: float) -> float:
    r = min(max(r, lo + 1e-9 * (hi - lo)), hi - 1e-9 * (hi - lo))
    return -log((hi - lo) / (r - lo) - 1)


def softmax_from_zero(x: list[float]) -> list[float]:
    """Weights of one fixed 0 and the rest."""
    e = np.exp(np.array([0.0, *x]))
    return (e / e.sum()).tolist()


def restrict(x: list[float], k: int, max_ds: float = 1.5) -> Theta:
    """Free numbers to parameters: all but one weight, the peaks, then sigma_n, sigma_b, rho and ds."""
    n = k * (k + 1) // 2 - 1
    w = softmax_from_zero([sigmoid(a, *LIMITS["weight"]) for a in x[:n]])
    peaks = [sigmoid(a, *LIMITS["peak"]) for a in x[n : n + k]]
    sn, sb, rho, ds = x[n + k :]
    return Theta(w, peaks, exp(sigmoid(sn, *LIMITS["sigma_n"])), exp(sigmoid(sb, *LIMITS["sigma_b"])), exp(sigmoid(ds, log(0.5), log(max_ds))), sigmoid(rho, *LIMITS["rho"]))


def free(t: Theta, max_ds: float = 1.5) -> list[float]:
    w = [inverse_sigmoid(log(max(a, 1e-12) / max(t.weights[0], 1e-12)), *LIMITS["weight"]) for a in t.weights[1:]]
    return [*w, *[inverse_sigmoid(a, *LIMITS["peak"]) for a in t.peaks], inverse_sigmoid(log(t.sigma_n), *LIMITS["sigma_n"]), inverse_sigmoid(log(t.sigma_b), *LIMITS["sigma_b"]), inverse_sigmoid(t.rho, *LIMITS["rho"]), inverse_sigmoid(log(t.ds), log(0.5), log(max_ds))]


def project_gaps(x: list[float], gap: float) -> list[float]:
    """The nearest values at least ``gap`` apart, in the same order: isotonic regression after the gaps are taken off, kept in 0..1. Not part of the fit by default."""
    order = sorted(range(len(x)), key=lambda k: (x[k], k))
    blocks: list[list[float]] = []
    for place, k in enumerate(order):
        blocks.append([x[k] - gap * place, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            a, n = blocks.pop()
            b, m = blocks.pop()
            blocks.append([(a * n + b * m) / (n + m), n + m])
    level = [a for a, n in blocks for _ in range(int(n))]
    top = 1 - gap * (len(x) - 1)
    out = [0.0] * len(x)
    for place, k in enumerate(order):
        out[k] = min(max(level[place], 0.0), max(0.0, top)) + gap * place
    return out


def search(x: list[float], step: float = 0.5, iterations: int = 200, stop: float = 1e-4, restart: int = 100, at_once: int = 1) -> Generator[np.ndarray, np.ndarray, tuple[list[float], float]]:
    """Downhill simplex: yields points to evaluate, is sent their values, returns the best point and its value.

    With several corners ``at_once``, each iteration asks in one go for all that it may need: for each of the worst corners the mirrored point, the one twice as far, and the two halfway ones. A
    simplex that finds nothing better shrinks. Every ``restart`` iterations it starts again around the best point with steps smaller by a twentieth.
    """
    n, at_once = len(x), max(1, min(at_once, len(x)))

    def corners(p: np.ndarray, s: float) -> np.ndarray:
        return np.vstack([p, p + s * np.eye(n)])

    points = corners(np.array(x, float), step)
    values = yield points
    for k in range(1, iterations + 1):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.sqrt(((points - points.mean(axis=0)) ** 2).sum(axis=1).mean()) < stop:
            break
        if k % restart == 0:
            step *= 0.95
            points = corners(points[0], step)
            values = yield points
            continue
        middle = points[: n + 1 - at_once].mean(axis=0)
        away = middle - points[n + 1 - at_once :]
        asked = np.concatenate([middle + c * away for c in (1.0, 2.0, 0.5, -0.5)])
        if at_once > 1:
            mirrored, further, outer, inner = (yield asked).reshape(4, at_once)
        else:
            # One corner alone: after the mirrored point, only the one that it calls for.
            mirrored = yield asked[:1]
            further, outer, inner = (np.full(1, np.inf) for _ in range(3))
            if mirrored[0] < values[0]:
                further = yield asked[1:2]
            elif mirrored[0] >= values[-2]:
                outer, inner = ((yield asked[2:3]), inner) if mirrored[0] < values[-1] else (outer, (yield asked[3:4]))
        moved = False
        fresh, fresh_values = points.copy(), values.copy()
        for j in range(at_once):
            i = n + 1 - at_once + j
            choice = None
            if mirrored[j] < values[0]:
                choice = (1, further[j]) if further[j] < mirrored[j] else (0, mirrored[j])
            elif mirrored[j] < values[i - 1]:
                choice = (0, mirrored[j])
            else:
                half = (2, outer[j]) if mirrored[j] < values[i] else (3, inner[j])
                choice = half if half[1] < min(mirrored[j], values[i]) else None
            if choice is not None:
                fresh[i], fresh_values[i], moved = asked[choice[0] * at_once + j], choice[1], True
        if moved:
            points, values = fresh, fresh_values
        else:
            points[1:] = points[0] + 0.5 * (points[1:] - points[0])
            values[1:] = yield points[1:]
    k = int(np.argmin(values))
    return points[k].tolist(), float(values[k])


def minimise(f: Callable[[np.ndarray], float], x: list[float], step: float = 0.5, iterations: int = 200, stop: float = 1e-4, restart: int = 100) -> tuple[list[float], float]:
    """``search`` with a plain function."""
    return in_step([search(x, step, iterations, stop, restart)], lambda asked: [np.array([f(p) for p in points]) for points in asked])[0]


def first_guess(peaks: list[float], max_ds: float = 1.5) -> Theta:
    """Where a fit begins: the given peaks, equal phases, hardly any interface, all else in the middle of its range."""
    k = len(peaks)
    pairs = k * (k - 1) // 2
    weights = [0.0] * (k - 1) + [inverse_sigmoid(0.99 * LIMITS["weight"][0], *LIMITS["weight"])] * pairs
    return restrict([*weights, *[inverse_sigmoid(p, *LIMITS["peak"]) for p in peaks], 0.0, 0.0, 0.0, 0.0], k, max_ds)


#: Voxels of the fit at most, batches of the first stage, iterations and the simplex's size to stop at in both.
SAMPLE, BATCHES = 1_000_000, 100
FIRST, LAST = (100, 1e-5), (10_000, 1e-4)
#: Corners of the simplex that one pass over the sample moves.
AT_ONCE = 4
_PART = 1 << 12


def costs(u: np.ndarray, v: np.ndarray, t: Theta, count: int) -> float:
    """The sum of the negative logarithms of the density, some rows at a time."""
    s2 = t.sigma_n**2
    a, total = s2 * (1 - t.rho), 0.0
    at = [np.array(nodes(t, i, j, count)).T for i, j in t.pairs]
    for k in range(0, len(u), _PART):
        x, y = u[k : k + _PART], v[k : k + _PART]
        p = sum(w * np.exp(-0.5 * (x - peak) ** 2 / s2) for w, peak in zip(t.weights, t.peaks, strict=False)) * (2 * sqrt(2) / pi / (s2 * s2 * (1 - t.rho) ** 1.5)) * y * y * np.exp(-y * y / a)
        for w, (level, g, weight) in zip(t.weights[len(t.peaks) :], at, strict=True):
            far = -0.5 * (x[:, None] - level) ** 2 / s2
            near = np.exp(far - (y[:, None] - g) ** 2 / a)
            # The difference of two exponentials; where the interface is nearly flat, its limit.
            flat = g < 1e-6 * sqrt(a)
            inner = np.where(flat, near * (4 * y[:, None] / a), (near - np.exp(far - (y[:, None] + g) ** 2 / a)) / np.where(flat, 1.0, g))
            p = p + w / (2 * sqrt(2) * pi) * y / (t.ds * t.sigma_n * sqrt(a)) * (inner @ weight)
        total -= float(np.log(np.maximum(p, 1e-300)).sum())
    return total


#: Tiles across (u, v), polynomials along a side of one, and what its last two coefficients may come to.
TILES, DEGREES, EXACT = (12, 12), 14, 1e-8
#: Rows from which polynomials cost less than the rows one by one.
LEAST_ROWS = 512


@cache
def _chebyshev() -> tuple[np.ndarray, np.ndarray]:
    """The polynomials' nodes on -1..1, and the matrix that turns values there into coefficients."""
    angle = np.pi * (np.arange(DEGREES) + 0.5) / DEGREES
    return np.cos(angle), np.cos(np.arange(DEGREES)[:, None] * angle) * np.where(np.arange(DEGREES)[:, None] == 0, 1, 2) / DEGREES


class Rows:
    """Rows of (u, v) whose ``costs`` are asked for again and again: what doesn't depend on the parameters is worked out once.

    The logarithm of the density over v squared is smooth. In tiles of (u, v) it is a polynomial of both, found from its values at a few nodes, and its sum over a tile's rows follows from the
    sums of the polynomials' terms over them, whatever their number. Where a polynomial's last coefficients aren't negligible, the tile's rows are gone through one by one, as all are if they are
    few or a v is next to 0; so a row's cost is right to about ``EXACT`` whatever the parameters.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray):
        tile, where, self.middle = np.zeros(len(u), np.int64), [], []
        for x, tiles in zip((u, v), TILES, strict=True):
            lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 1.0)
            wide = (hi - lo) / tiles or 1.0
            k = np.clip(((x - lo) / wide).astype(np.int64), 0, tiles - 1)
            self.middle.append((lo + (np.arange(tiles) + 0.5) * wide, wide / 2))
            tile = tile * tiles + k
            where.append((x - lo) / wide * 2 - 2 * k - 1)
        order = np.argsort(tile, kind="stable")
        self.u, self.v, tile = u[order], v[order], tile[order]
        self.begins = np.searchsorted(tile, np.arange(np.prod(TILES) + 1))
        self.usable = len(v) >= LEAST_ROWS and float(v.min()) > 1e-9
        if self.usable:
            terms = []
            for x in where:
                x = np.clip(x[order], -1, 1)
                terms.append(np.empty((len(x), DEGREES)))
                terms[-1][:, 0], terms[-1][:, 1] = 1, x
                for k in range(2, DEGREES):
                    terms[-1][:, k] = 2 * x * terms[-1][:, k - 1] - terms[-1][:, k - 2]
            self.sums = np.array([terms[0][i:j].T @ terms[1][i:j] for i, j in zip(self.begins, self.begins[1:], strict=False)])
            self.squares = np.diff(np.concatenate([[0.0], np.cumsum(2 * np.log(self.v))])[self.begins])

    def costs(self, t: Theta, count: int) -> float:
        """As ``costs`` of the rows."""
        if not self.usable:
            return costs(self.u, self.v, t, count)
        at, into = _chebyshev()
        x, y = ((m[:, None] + half * at).ravel() for m, half in self.middle)
        values = self.products(x, y, t, count).reshape(TILES[0], DEGREES, TILES[1], DEGREES).transpose(0, 2, 1, 3)
        # Below the least number that a density is taken for, and beyond all numbers, there is no polynomial.
        good = ((values > 1e-270) & (values < 1e270)).all(axis=(-2, -1))
        found = into @ np.log(np.where(good[..., None, None], values, 1.0)) @ into.T
        good &= np.maximum(np.abs(found[..., -2:, :]).sum(axis=(-2, -1)), np.abs(found[..., -2:]).sum(axis=(-2, -1))) <= EXACT
        good = good.ravel()
        total = -float((found.reshape(self.sums.shape)[good] * self.sums[good]).sum() + self.squares[good].sum())
        rest = np.repeat(~good, np.diff(self.begins))
        return total + costs(self.u[rest], self.v[rest], t, count) if rest.any() else total

    @staticmethod
    def products(x: np.ndarray, y: np.ndarray, t: Theta, count: int) -> np.ndarray:
        """The density over y squared at all pairs of some x and some y > 0."""
        s2 = t.sigma_n**2
        a, k = s2 * (1 - t.rho), len(t.peaks)
        at = np.array([(level, g, w * weight) for w, (i, j) in zip(t.weights[k:], t.pairs, strict=True) for level, g, weight in nodes(t, i, j, count)]).reshape(-1, 3)
        level, g, weight = np.concatenate([t.peaks, at[:, 0]]), at[:, 1], at[:, 2]
        of_x = np.exp(-0.5 * (x[:, None] - level) ** 2 / s2)
        z = 4 / a * y[:, None] * g
        # exp(-(y - g)^2 / a) - exp(-(y + g)^2 / a) over g y, and its limit where the interface is flat.
        ratio = np.where(z > 1e-12, -np.expm1(-z) / np.where(z > 1e-12, z, 1.0), 1.0)
        interfaces = np.exp(-((y[:, None] - g) ** 2) / a) * ratio * (4 / a * weight / (2 * sqrt(2) * pi * t.ds * t.sigma_n * sqrt(a)))
        pure = np.exp(-(y[:, None] ** 2) / a) * (np.array(t.weights[:k]) * (2 * sqrt(2) / pi / (s2 * s2 * (1 - t.rho) ** 1.5)))
        return of_x @ np.concatenate([pure, interfaces], axis=1).T


def log_mass(t: Theta, window: tuple[float, float, float], count: int) -> float:
    return log(max(total_mass(t, *window, count), 1e-300))


def mean_cost(u: np.ndarray, v: np.ndarray, t: Theta, window: tuple[float, float, float], count: int) -> float:
    """The mean negative logarithm of the density inside the window."""
    return costs(u, v, t, count) / len(u) + log_mass(t, window, count)


def passed(sample: Sample, thetas: list[Theta], window: tuple[float, float, float], count: int = 24) -> list[float]:
    """``mean_cost`` of all candidates over the whole sample, in one pass."""

    def each(columns: list[np.ndarray]) -> np.ndarray:
        rows = Rows(*columns)
        return np.array([[rows.costs(t, count)] for t in thetas])

    found = summed(sample, len(thetas), each)
    return [float(x) / sample.count + log_mass(t, window, count) for x, t in zip(found[:, 0], thetas, strict=True)]


def over_batch(sample: Sample, batch: int, x: list[float], step: float, window: tuple[float, float, float], k: int, first: tuple[int, float], max_ds: float, count: int) -> list[float]:
    """The simplex search over one batch, by the task that reads it: a batch is one part of the sample. Without a row, ``x``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches), pa.schema([("u", pa.float64()), ("v", pa.float64())]))
        u, v = own.column("u").to_numpy(), own.column("v").to_numpy()
        if len(u):
            rows = Rows(u, v)

            def cost(y: np.ndarray) -> float:
                t = restrict(list(y), k, max_ds)
                return rows.costs(t, count) / len(u) + log_mass(t, window, count)

            found, value = minimise(cost, x, step, first[0], first[1])
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64())), pa.array([value])], ["x", "value"])

    own = sample.table.where(F.col("part") == batch).select("u", "v").coalesce(1)
    rows = own.mapInArrow(work, "x array<double>, value double").collect()
    return list(rows[0].x) if rows else x


def fit(samples: DataFrame, start: Theta, window: tuple[float, float, float], key: tuple[str, ...] = ("n", "row", "col"), most: int = SAMPLE, batches: int = BATCHES, first: tuple[int, float] = FIRST, last: tuple[int, float] = LAST, max_ds: float = 1.5, count: int = 24, at_once: int = AT_ONCE) -> tuple[Theta, float]:
    """Maximum likelihood of (u, v): a simplex search over one batch after another, each from where the last one ended, then over the whole sample.

    The sample is drawn by the hash of the keys, at most ``most`` rows, so it comes from the whole volume; its parts are the batches. A batch is searched by the task that reads it. The second
    stage evaluates several candidate points in each pass over all parts. No sample comes to the driver. Without a row: the start, and NaN.
    """
    sample = draw(samples.select(*key, "u", "v"), ["u", "v"], list(key), most, batches)
    if not sample.count:
        return start, float("nan")
    x, k = free(start, max_ds), len(start.peaks)
    for batch in range(batches):
        x = over_batch(sample, batch, x, 1.0 if batch == 0 else 0.3, window, k, first, max_ds, count)

    def evaluate(asked: list[np.ndarray]) -> list[np.ndarray]:
        return [np.array(passed(sample, [restrict(list(p), k, max_ds) for p in points], window, count)) for points in asked]

    x, value = in_step([search(x, 0.5, last[0], last[1], at_once=at_once)], evaluate)[0]
    sample.drop()
    return restrict(x, k, max_ds), value
