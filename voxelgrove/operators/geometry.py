"""The cylinder's circle: one for each slice on the executors, then the largest that lies inside all of them.

A slice's levels are counted and its white runs found by Spark; only the counts of 256 levels and the runs of one slice come together in a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def otsu(counts: np.ndarray) -> int:
    """The 8-bit threshold that parts the levels best, of their 256 counts; above it is white."""
    p = counts / max(1, counts.sum())
    w, m = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return int(np.nan_to_num(between, posinf=0.0).argmax())


def runs_of(white: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first col, last col) of the runs of a picture's white points."""
    out = []
    for r, line in enumerate(white):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        out += [(r, int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


class _Sets:
    """Numbers joined into sets; a set is called by its least number."""

    def __init__(self) -> None:
        self.parents: list[int] = []

    def new(self) -> int:
        self.parents.append(len(self.parents))
        return len(self.parents) - 1

    def root(self, k: int) -> int:
        while self.parents[k] != k:
            self.parents[k] = self.parents[self.parents[k]]
            k = self.parents[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parents[max(a, b)] = min(a, b)


def _touching(above: list[tuple[int, int, int]], now: list[tuple[int, int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """Pairs of runs of two lines, each in order, that share a column, or with ``reach`` 1 touch at a corner."""
    i = 0
    for a, b, k in now:
        while i and above[i - 1][1] + reach >= a:
            i -= 1
        while i < len(above) and above[i][1] + reach < a:
            i += 1
        while i < len(above) and above[i][0] <= b + reach:
            yield above[i][2], k
            i += 1


_FAR = 1 << 40


def enclosed_areas(runs: Iterable[tuple[int, int, int]]) -> list[tuple[float, tuple[int, int], list[tuple[int, int, int]]]]:
    """(area, first point, filled runs) of each outermost part of a picture, its runs given by row, then by col.

    White points belong together over edges and corners, black ones over edges; black that the outside does not reach is filled, with all that lies in it. The area is that of the polygon through
    the outermost points' centres: 1 for every four neighbouring points in a square, 1/2 for every three.
    """
    sets = _Sets()
    outside = sets.new()
    lines: list[tuple[int, list[tuple[int, int, int]]]] = []
    above: list[tuple[int, int, int]] = []
    gaps_above, at = [(-_FAR, _FAR, outside)], None
    joined: list[tuple[int, int, int]] = []
    grouped = ((r, [(a, b) for _, a, b in own]) for r, own in groupby(runs, key=itemgetter(0)))
    for r, own in grouped:
        if at is not None and r != at + 1:
            for _, _, k in gaps_above:
                sets.join(outside, k)
            above, gaps_above = [], [(-_FAR, _FAR, outside)]
        now = [(a, b, sets.new()) for a, b in own]
        gaps = [(-_FAR, now[0][0] - 1, outside)]
        for (_, b, left), (c, _, right) in pairwise(now):
            hole = sets.new()
            gaps.append((b + 1, c - 1, hole))
            joined.append((hole, left, right))
        gaps.append((now[-1][1] + 1, _FAR, outside))
        for one, other in _touching(above, now, 1):
            sets.join(one, other)
        for one, other in _touching(gaps_above, gaps, 0):
            sets.join(one, other)
        lines.append((r, now))
        above, gaps_above, at = now, gaps, r
    for _, _, k in gaps_above:
        sets.join(outside, k)
    holes = [x for x in joined if sets.root(x[0]) != outside]
    closed = {left for _, left, _ in holes}
    for hole, left, right in holes:
        sets.join(left, right)
        sets.join(hole, left)
    filled: dict[int, list[tuple[int, int, int]]] = {}
    area: dict[int, float] = {}
    before: list[tuple[int, int, int]] = []
    last = None
    for r, now in lines:
        whole: list[tuple[int, int, int]] = []
        for k, (a, b, part) in enumerate(now):
            if k and now[k - 1][2] in closed:
                whole[-1] = (whole[-1][0], b, whole[-1][2])
            else:
                whole.append((a, b, sets.root(part)))
        spans = {k: (a, b) for k, (a, b, _) in enumerate(whole)}
        for a, b, part in whole:
            filled.setdefault(part, []).append((r, a, b))
        if last == r - 1:
            ends = {k: (a, b) for k, (a, b, _) in enumerate(before)}
            for i, j in _touching([(a, b, k) for k, (a, b, _) in enumerate(before)], [(a, b, k) for k, (a, b, _) in enumerate(whole)], 1):
                (a, b), (c, d) = ends[i], spans[j]
                # Squares of four, and at either end of one run those where the other goes on.
                size = max(0, min(b, d) - max(a, c)) + 0.5 * ((a < c <= b) + (a <= d < b) + (c < a <= d) + (c <= b < d))
                area[whole[j][2]] = area.get(whole[j][2], 0.0) + size
        before, last = whole, r
    return [(area.get(k, 0.0), (own[0][0], own[0][1]), own) for k, own in filled.items()]


def largest_part(runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Ends (row, col) of the filled runs of the part that encloses the most, the first one among equals; they are enough for the enclosing circle."""
    parts = enclosed_areas(runs)
    if not parts:
        return np.zeros((0, 2))
    _, _, own = min(parts, key=lambda x: (-x[0], x[1]))
    return np.array([(r, c) for r, a, b in own for c in {a, b}], float)


def enclosing_circle(points: np.ndarray, seed: int = 0) -> tuple[float, float, float]:
    """(row, col, radius) of the smallest circle around the points, by incremental construction in random order."""
    p = points[np.random.default_rng(seed).permutation(len(points))]

    def outside(c: tuple[float, float, float], upto: int) -> int:
        far = np.hypot(p[:upto, 0] - c[0], p[:upto, 1] - c[1]) > c[2] * (1 + 1e-12) + 1e-9
        return int(far.argmax()) if far.any() else -1

    def through(*q: np.ndarray) -> tuple[float, float, float]:
        if len(q) == 1:
            return float(q[0][0]), float(q[0][1]), 0.0
        if len(q) == 2:
            m = (q[0] + q[1]) / 2
            return float(m[0]), float(m[1]), float(np.hypot(*(q[0] - m)))
        a, b = q[1] - q[0], q[2] - q[0]
        d = 2 * (a[0] * b[1] - a[1] * b[0])
        if abs(d) < 1e-12:
            return max((through(x, y) for x, y in ((q[0], q[1]), (q[0], q[2]), (q[1], q[2]))), key=lambda c: c[2])
        x, y = (b[1] * (a @ a) - a[1] * (b @ b)) / d, (a[0] * (b @ b) - b[0] * (a @ a)) / d
        return float(q[0][0] + x), float(q[0][1] + y), float(np.hypot(x, y))

    if not len(p):
        return 0.0, 0.0, 0.0
    c = through(p[0])
    while (i := outside(c, len(p))) >= 0:
        c = through(p[i])
        while (j := outside(c, i)) >= 0:
            c = through(p[i], p[j])
            while (k := outside(c, j)) >= 0:
                c = through(p[i], p[j], p[k])
                if outside(c, j) == k:
                    break
            if outside(c, i) == j:
                break
        if outside(c, len(p)) == i:
            break
    return c


def slice_circle(page: np.ndarray) -> tuple[float, float, float]:
    """(row, col, radius) of the object in a picture: thresholded at its best level, turned round if the border is mostly white."""
    span = page.max() - page.min()
    levels = np.rint((page - page.min()) * (255.0 / span if span else 0.0)).astype(np.uint8)
    white = levels > otsu(np.bincount(levels.ravel(), minlength=256))
    border = sum(int(x.sum()) for x in (white[0], white[-1], white[:, 0], white[:, -1]))
    return enclosing_circle(largest_part(runs_of(~white if border > sum(white.shape) else white)))


def circles(voxels: DataFrame, value: str = "u") -> DataFrame:
    """(n, yc, xc, r) for each slice, its pages starting at row and col 0. A place without a voxel is black; a slice without an object has a circle of radius 0 at 0, 0."""
    u = F.col(value).cast("double")
    size = voxels.groupBy("n").agg(F.min(u).alias("lo"), F.max(u).alias("hi"), (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    # A row for each slice, joined to the voxels.
    scale = F.when(F.col("hi") > F.col("lo"), F.lit(255.0) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    levels = voxels.join(F.broadcast(size), "n").select("n", "row", "col", "h", "w", F.rint((u - F.col("lo")) * scale).cast("int").alias("level"))
    at_edge = (F.col("row") == 0).cast("int") + (F.col("row") == F.col("h") - 1).cast("int") + (F.col("col") == 0).cast("int") + (F.col("col") == F.col("w") - 1).cast("int")
    counts = levels.groupBy("n", "h", "w", "level").agg(F.count("*").alias("count"), F.sum(at_edge).alias("edge"))

    def cut(table: pa.Table) -> pa.Table:
        n, h, w = (int(table.column(c)[0].as_py()) for c in ("n", "h", "w"))
        level, count, edge = (table.column(c).to_numpy() for c in ("level", "count", "edge"))
        every = np.bincount(level, count, 256)
        every[0] += h * w - count.sum()
        threshold = otsu(every)
        return pa.table({"n": pa.array([n], pa.int32()), "threshold": pa.array([threshold], pa.int32()), "turned": pa.array([bool(edge[level > threshold].sum() > h + w)])})

    cuts = counts.groupBy("n").applyInArrow(cut, "n int, threshold int, turned boolean")
    white = levels.join(F.broadcast(cuts), "n").where((F.col("level") > F.col("threshold")) != F.col("turned"))
    line = Window.partitionBy("n", "row").orderBy("col")
    ends = white.select("n", "row", "col", (F.coalesce(F.lag("col").over(line), F.lit(-2)) != F.col("col") - 1).alias("first"), (F.coalesce(F.lead("col").over(line), F.lit(-2)) != F.col("col") + 1).alias("last")).where("first or last")
    runs = ends.withColumn("to", F.when(F.col("last"), F.col("col")).otherwise(F.lead("col").over(line))).where("first").select("n", "row", "col", "to")

    def find(table: pa.Table) -> pa.Table:
        n, row, a, b = (table.column(c).to_numpy() for c in ("n", "row", "col", "to"))
        order = np.lexsort((a, row))
        yc, xc, r = enclosing_circle(largest_part(zip(row[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True)))
        return pa.table({"n": pa.array([int(n[0])], pa.int32()), "yc": [yc], "xc": [xc], "r": [r]})

    found = runs.groupBy("n").applyInArrow(find, "n int, yc double, xc double, r double")
    zero = F.lit(0.0)
    return size.select("n").join(found, "n", "left").select("n", F.coalesce("yc", zero).alias("yc"), F.coalesce("xc", zero).alias("xc"), F.coalesce("r", zero).alias("r"))


def _binding_centres(c: np.ndarray) -> list[tuple[float, float]]:
    """Centres where one, two or three of the circles can bind: a circle's own; on the line of two centres; where three have equal room."""
    out = [(float(y), float(x)) for y, x, _ in c]
    for i, j in combinations(range(len(c)), 2):
        d = float(np.hypot(*(c[j, :2] - c[i, :2])))
        if d > 0:
            # As far from the first centre as its radius exceeds the room left.
            t = (d + c[i, 2] - c[j, 2]) / 2 / d
            if 0 <= t <= 1:
                out.append(tuple((c[i, :2] + t * (c[j, :2] - c[i, :2])).tolist()))
    for i, j, k in combinations(range(len(c)), 3):
        p, r = c[[i, j, k], :2], c[[i, j, k], 2]
        left = 2 * (p[1:] - p[0])
        if abs(np.linalg.det(left)) < 1e-14:
            continue
        # distance = r_i - room for all three: two differences are linear in the centre and the room, the rest is a quadratic in the room.
        square = (p * p).sum(axis=1) - r * r
        base, slope = np.linalg.solve(left, square[1:] - square[0]), np.linalg.solve(left, 2 * (r[1:] - r[0]))
        b = base - p[0]
        for room in np.roots([slope @ slope - 1, 2 * (b @ slope) + 2 * r[0], b @ b - r[0] * r[0]]):
            if abs(room.imag) < 1e-9 * max(1.0, abs(room)):
                out.append(tuple((base + slope * room.real).tolist()))
    return out


def inscribed_circle(found: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """The largest circle inside all of them (row, col, radius; negative if they have no point in common).

    The room at a centre, min(r_i - distance_i), is concave, and at most three circles bind where it is greatest. The circle violated most joins those seen to bind, the best centre for
    these is found among those of their subsets, and so on until no circle is violated: exact but for rounding, after a few rounds.
    """
    c = np.unique(np.array(found, float), axis=0)

    def room(at: tuple[float, float], of: np.ndarray) -> np.ndarray:
        return of[:, 2] - np.hypot(of[:, 0] - at[0], of[:, 1] - at[1])

    binding = [int(c[:, 2].argmin())]
    at = (float(c[binding[0], 0]), float(c[binding[0], 1]))
    value = float(c[binding[0], 2])
    while True:
        rooms = room(at, c)
        worst = int(rooms.argmin())
        if worst in binding or rooms[worst] >= value - 1e-12 * max(1.0, abs(value)):
            return at[0], at[1], float(rooms.min())
        binding.append(worst)
        some = c[binding]
        at = max(_binding_centres(some), key=lambda p: float(room(p, some).min()))
        value = float(room(at, some).min())


def volume_mask(voxels: DataFrame, value: str = "u") -> tuple[float, float, float]:
    """(yc, xc, r) that lies inside every slice's circle; a row for each slice comes to the driver."""
    return inscribed_circle([(r.yc, r.xc, r.r) for r in circles(voxels, value).collect()])
