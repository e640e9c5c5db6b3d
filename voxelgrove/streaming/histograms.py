"""A histogram of voxels that arrive in slices, kept up to date by Structured Streaming: the state is the bins, whatever the number of voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.histogram import bin_of


def running_histogram(voxels: DataFrame, bins: int, lo: float, hi: float, value: str = "u") -> DataFrame:
    """(bin, count) over a stream (for the update or complete mode), or over a table; values outside lo..hi are left out."""
    x = F.col(value).cast("double")
    return voxels.where(x.between(lo, hi)).groupBy(bin_of(x, F.lit(lo), F.lit(hi), bins).alias("bin")).agg(F.count("*").alias("count"))
