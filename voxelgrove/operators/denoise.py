"""Total-variation denoising by Chambolle's dual iteration, in rounds over blocks; and the same iteration as window expressions, for a few steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import AXES, Dense, bounding_box, dropped, plan_blocks, run_round, task_memory, trace_of, trace_table, written
from .stencil import divergence, following

TAU = 0.165
ITERATIONS = 150
LAMBDA = 0.06
DUAL = ["q1", "q2", "q3"]
#: Numbers for each voxel of a block while it is worked on.
ARRAYS = 22


def iterate(d: Dense, iterations: int, lam: float, tau: float) -> dict[str, np.ndarray]:
    """Dual steps; r is the change of a voxel's vector, squared, in the last one, trace the largest of them in each."""
    f, q = d.values["u"], [d.values[c] for c in DUAL]
    change, trace = np.zeros_like(f), []
    for _ in range(iterations):
        v = sum(d.backward_part(x, k) for k, x in enumerate(q)) - f / lam
        g = [d.forward(v, k) for k in range(3)]
        scale = 1 + tau * np.sqrt(sum(x * x for x in g))
        fresh = [(x + tau * y) / scale for x, y in zip(q, g, strict=True)]
        change = sum((x - y) ** 2 for x, y in zip(q, fresh, strict=True))
        q = fresh
        trace.append(d.most(change))
    return {"u": f, "q1": q[0], "q2": q[1], "q3": q[2], "r": change, "trace": trace}


def denoise(voxels: DataFrame, iterations: int = ITERATIONS, lam: float = LAMBDA, tau: float = TAU, block: tuple[int, int, int] | None = None, per_round: int | None = None) -> DataFrame:
    """(n, row, col, u, d, r): the input, the denoised value, and the last squared change. ``per_round`` iterations need a halo of as many voxels and one; both it and ``block`` follow from the volume
    and the executors' memory unless given (see ``plan_blocks``)."""
    return _rounds(voxels, iterations, lam, tau, block, per_round, None)


def denoise_traced(voxels: DataFrame, iterations: int = ITERATIONS, lam: float = LAMBDA, tau: float = TAU, block: tuple[int, int, int] | None = None, per_round: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``denoise``, and (iter, maxdeltaq): the largest change of a dual vector in each iteration."""
    trace: list[float] = []
    out = _rounds(voxels, iterations, lam, tau, block, per_round, trace)
    return out, trace_table(voxels.sparkSession, trace)


def _rounds(voxels: DataFrame, iterations: int, lam: float, tau: float, block: tuple[int, int, int] | None, per_round: int | None, trace: list[float] | None) -> DataFrame:
    state = voxels.select(*AXES, F.col("u").cast("double").alias("u"), *[F.lit(0.0).alias(c) for c in DUAL])
    left, box = iterations, None
    if iterations and (block is None or per_round is None) and (box := bounding_box(voxels)) is not None:
        spark = voxels.sparkSession
        plan = plan_blocks(box, iterations, 1, 1, len(DUAL) + 1, ARRAYS, task_memory(spark), spark.sparkContext.defaultParallelism, block, per_round)
        block, per_round = plan.block, plan.per_round
    block, per_round = block or (48, 48, 48), per_round or 10
    while left > 0:
        n = min(per_round, left)
        left -= n
        after = written(run_round(state, ["u", *DUAL], lambda d, n=n: iterate(d, n, lam, tau), block, n + 1, ["u", *DUAL, "r"], box), f"dual_{left}")
        if trace is not None:
            trace += trace_of(after)
        dropped(state)
        state = after
    return divergence(state, ("q1", "q2", "q3")).withColumn("d", F.col("u") - lam * F.col("div")).select(*AXES, "u", "d", *(["r"] if "r" in state.columns else []))


def denoise_by_windows(voxels: DataFrame, iterations: int = 2, lam: float = LAMBDA, tau: float = TAU) -> DataFrame:
    """The same as expressions over windows; each step adds six of them, so for a few steps only."""
    state = voxels.select(*AXES, "u", *[F.lit(0.0).alias(c) for c in DUAL], F.lit(0.0).alias("r"))
    for _ in range(iterations):
        state = divergence(state, ("q1", "q2", "q3")).withColumn("w", F.col("div") - F.col("u") / lam)
        for k, axis in enumerate(AXES):
            state = state.withColumn(f"g{k}", F.coalesce(following(axis, "w") - F.col("w"), F.lit(0.0)))
        norm = F.sqrt(F.col("g0") * F.col("g0") + F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2"))
        state = state.withColumn("s", 1 + tau * norm)
        fresh = [(F.col(q) + tau * F.col(f"g{k}")) / F.col("s") for k, q in enumerate(DUAL)]
        change = sum(((F.col(q) - x) * (F.col(q) - x) for q, x in zip(DUAL, fresh, strict=True)), F.lit(0.0))
        state = state.select(*AXES, "u", *[x.alias(q) for q, x in zip(DUAL, fresh, strict=True)], change.alias("r"))
    return divergence(state, ("q1", "q2", "q3")).select(*AXES, "u", (F.col("u") - lam * F.col("div")).alias("d"), "r")


def residual(denoised: DataFrame) -> DataFrame:
    """One row: the largest change of a dual vector in the last step."""
    return denoised.agg(F.sqrt(F.max("r")).alias("residual"))
