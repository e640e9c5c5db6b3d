"""Finite differences by windows along the three axes. A neighbour counts only if its index is adjacent, so any mask will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = {"n": ("row", "col"), "row": ("n", "col"), "col": ("n", "row")}


def previous(axis: str, value: str | Column) -> Column:
    """The value one step back, null where the mask has no voxel there."""
    w = Window.partitionBy(*AXES[axis]).orderBy(axis)
    return F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(value).over(w))


def following(axis: str, value: str | Column) -> Column:
    w = Window.partitionBy(*AXES[axis]).orderBy(axis)
    return F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(value).over(w))


def gradient_magnitude(voxels: DataFrame, value: str = "u", name: str = "v") -> DataFrame:
    """Adds half the norm of the central differences; -1 where one of the six neighbours is missing. One shuffle for each axis."""
    out = voxels
    for axis in AXES:
        out = out.withColumn(f"_d_{axis}", following(axis, value) - previous(axis, value))
    squares = sum((F.col(f"_d_{a}") * F.col(f"_d_{a}") for a in AXES), F.lit(0.0))
    return out.withColumn(name, F.coalesce(0.5 * F.sqrt(squares), F.lit(-1.0))).drop(*[f"_d_{a}" for a in AXES])


def forward_gradient(voxels: DataFrame, value: str = "u") -> DataFrame:
    """Adds g_n, g_row and g_col: the next value less this one, 0 at the outer faces."""
    out = voxels
    for axis in AXES:
        out = out.withColumn(f"g_{axis}", F.coalesce(following(axis, value) - F.col(value), F.lit(0.0)))
    return out


def divergence(field: DataFrame, parts: tuple[str, str, str] = ("g_n", "g_row", "g_col"), name: str = "div") -> DataFrame:
    """Adds the backward divergence: by axis, less the part of the voxel before where there is one, plus its own where one follows."""
    out = field
    for axis, part in zip(AXES, parts, strict=True):
        own = F.when(following(axis, F.lit(1)).isNotNull(), F.col(part)).otherwise(0.0)
        out = out.withColumn(f"_e_{axis}", own - F.coalesce(previous(axis, part), F.lit(0.0)))
    return out.withColumn(name, sum((F.col(f"_e_{a}") for a in AXES), F.lit(0.0))).drop(*[f"_e_{a}" for a in AXES])
