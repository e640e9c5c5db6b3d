"""Potts segmentation into K labels by a primal-dual iteration on the simplex relaxation, in rounds over blocks.

Shares V and dual vectors of the first K-1 labels are stored; the last label's follow, as shares sum to 1 and dual vectors to 0.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.voxel import argmax_label, check_labels, nearest_label
from .blocks import AXES, Dense, bounding_box, dropped, plan_blocks, run_round, task_memory, trace_of, trace_table, written

TAU = 0.99 * sqrt(1 / 12)
ITERATIONS = 100
SWEEPS = 20
STOP = 1e-6


def project_simplex(q: np.ndarray) -> np.ndarray:
    """Along the first axis."""
    k = len(q)
    down = -np.sort(-q, axis=0)
    sums = np.cumsum(down, axis=0) - 1
    ranks = np.arange(1, k + 1).reshape((k,) + (1,) * (q.ndim - 1))
    count = (down - sums / ranks > 0).sum(axis=0)
    theta = np.take_along_axis(sums, count[None] - 1, axis=0)[0] / count
    return np.maximum(q - theta, 0)


def project_pairs(q: np.ndarray) -> np.ndarray:
    """Vectors (K, 3, ...) to where every two differ by 1 at most: Dykstra's alternating projections. A voxel stops when it has settled, whatever others do."""
    k, shape = len(q), q.shape
    q = q.reshape(k, 3, -1).copy()
    live = np.arange(q.shape[2])
    kept = {(i, j): np.zeros((3, q.shape[2])) for i in range(k - 1) for j in range(i + 1, k)}
    for _ in range(SWEEPS):
        x = q[:, :, live]
        most = np.zeros(len(live))
        for (i, j), old in kept.items():
            h = x[j] - x[i] + old[:, live]
            length = np.sqrt((h * h).sum(axis=0))
            over = np.where(length > 1, (length - 1) / np.maximum(length, 1e-300), 0.0) * h
            delta = 0.5 * (over - old[:, live])
            most = np.maximum(most, np.sqrt((delta * delta).sum(axis=0)))
            x[i] += delta
            x[j] -= delta
            old[:, live] = over
        q[:, :, live] = x
        live = live[most >= STOP]
        if not len(live):
            break
    return q.reshape(shape)


def arrays(k: int) -> int:
    """Numbers for each voxel of a block while it is worked on: the state of k labels, dual vectors before and after with their gradients, and a vector for each pair."""
    return 5 * (k - 1) + 25 * k + 3 * k * (k - 1) // 2 + 12


def iterate(d: Dense, labels: list[float], iterations: int, lam: float, tau: float) -> dict[str, np.ndarray]:
    k, g = len(labels), d.values["u"]
    v = np.stack([d.values[f"v{i}"] for i in range(k - 1)])
    bar = np.stack([d.values[f"b{i}"] for i in range(k - 1)])
    xi = np.stack([np.stack([d.values[f"x{i}_{a}"] for a in range(3)]) for i in range(k - 1)])
    whole = lambda x, total: np.concatenate([x, (total - x.sum(axis=0))[None]])
    cost = np.stack([lam * (g - c) ** 2 for c in labels])
    change, trace = np.zeros_like(g), []
    for _ in range(iterations):
        full = whole(bar, 1.0)
        grad = np.stack([np.stack([d.forward(x, a) for a in range(3)]) for x in full])
        xi = project_pairs(whole(xi, 0.0) + tau * grad)[:-1]
        both = whole(xi, 0.0)
        div = np.stack([sum(d.backward_part(x[a], a) for a in range(3)) for x in both])
        old = whole(v, 1.0)
        fresh = project_simplex(old + tau * (div - cost))
        change = ((fresh - old) ** 2).sum(axis=0)
        bar, v = 2 * fresh[:-1] - old[:-1], fresh[:-1]
        trace.append(d.most(change))
    out = {"u": g, "r": change, "trace": trace}
    for i in range(k - 1):
        out |= {f"v{i}": v[i], f"b{i}": bar[i]} | {f"x{i}_{a}": xi[i][a] for a in range(3)}
    return out


def segment(voxels: DataFrame, labels: list[float], lam: float, iterations: int = ITERATIONS, tau: float = TAU, block: tuple[int, int, int] | None = None, per_round: int | None = None) -> DataFrame:
    """(n, row, col, u, label, c): the label of the largest share and its intensity; the nearest label to begin with. ``block`` and ``per_round`` follow from the volume, the
    number of labels and the executors' memory unless given (see ``plan_blocks``)."""
    return _rounds(voxels, labels, lam, iterations, tau, block, per_round, None)


def segment_traced(voxels: DataFrame, labels: list[float], lam: float, iterations: int = ITERATIONS, tau: float = TAU, block: tuple[int, int, int] | None = None, per_round: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``segment``, and (iter, maxdeltaq): the largest change of a voxel's shares in each iteration."""
    trace: list[float] = []
    out = _rounds(voxels, labels, lam, iterations, tau, block, per_round, trace)
    return out, trace_table(voxels.sparkSession, trace)


def _rounds(voxels: DataFrame, labels: list[float], lam: float, iterations: int, tau: float, block: tuple[int, int, int] | None, per_round: int | None, trace: list[float] | None) -> DataFrame:
    labels = check_labels(labels)
    k = len(labels)
    first = nearest_label(F.col("u"), labels)
    shares = [c for i in range(k - 1) for c in (F.when(first == i, 1.0).otherwise(0.0).alias(f"v{i}"), F.when(first == i, 1.0).otherwise(0.0).alias(f"b{i}"))]
    duals = [f"x{i}_{a}" for i in range(k - 1) for a in range(3)]
    columns = ["u", *[f"{p}{i}" for i in range(k - 1) for p in "vb"], *duals]
    state = voxels.select(*AXES, F.col("u").cast("double").alias("u"), *shares, *[F.lit(0.0).alias(c) for c in duals])
    left, box = iterations, None
    if iterations and (block is None or per_round is None) and (box := bounding_box(voxels)) is not None:
        spark = voxels.sparkSession
        plan = plan_blocks(box, iterations, 2, 0, len(columns), arrays(k), task_memory(spark), spark.sparkContext.defaultParallelism, block, per_round)
        block, per_round = plan.block, plan.per_round
    block, per_round = block or (48, 48, 48), per_round or 6
    while left > 0:
        n = min(per_round, left)
        left -= n
        # An iteration looks one voxel on for the gradient and one back for the divergence.
        after = written(run_round(state, columns, lambda d, n=n: iterate(d, labels, n, lam, tau), block, 2 * n, [*columns, "r"], box), f"shares_{left}")
        if trace is not None:
            trace += trace_of(after)
        dropped(state)
        state = after
    label = argmax_label(F.array(*[F.col(f"v{i}") for i in range(k - 1)]))
    out = state.withColumn("label", label)
    return out.select(*AXES, "u", "label", F.element_at(F.array(*[F.lit(c) for c in labels]), F.col("label") + 1).alias("c"))
