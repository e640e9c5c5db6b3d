"""Cylinder masks and crops."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_cylinder(voxels: DataFrame, yc: float, xc: float, r: float) -> DataFrame:
    """Voxels strictly inside the disc. The ranges say nothing new, but reach the scan as filters on row groups, which the disc itself can't."""
    box = F.col("row").between(ceil(yc - r), floor(yc + r)) & F.col("col").between(ceil(xc - r), floor(xc + r))
    return voxels.where(box & ((F.col("row") - yc) * (F.col("row") - yc) + (F.col("col") - xc) * (F.col("col") - xc) < r * r))


def reduced_radius(found: float, wanted: float | None) -> float:
    return wanted if wanted is not None and 1 < wanted < found else found


def spans(voxels: DataFrame) -> DataFrame:
    """(col, row_begin, row_end), the end exclusive."""
    return voxels.groupBy("col").agg(F.min("row").alias("row_begin"), (F.max("row") + 1).alias("row_end"))


def bounding_rows(voxels: DataFrame) -> DataFrame:
    return voxels.agg(F.min("row").alias("row_begin"), (F.max("row") + 1).alias("row_end"))


def crop_images(voxels: DataFrame, images: int, height: int) -> DataFrame:
    """The ``height`` images in the middle, renumbered from 0; all if height is not between 1 and the number of images."""
    if not 0 < height < images:
        return voxels
    first = (images - height) // 2
    return voxels.where(F.col("n").between(first, first + height - 1)).withColumn("n", F.col("n") - first)


def below(voxels: DataFrame, top: float, value: str = "u") -> DataFrame:
    """Voxels whose value is not above ``top``: those that a mixture is fitted to."""
    return voxels.where(F.col(value) <= top)


def require_equal_size(a: DataFrame, b: DataFrame) -> int:
    """The number of voxels that both volumes have; raises ValueError if they differ."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"the volumes have {n} and {m} voxels")
    return n
