"""Histograms with every bin, cumulative counts, and the cut-offs read off them.

A histogram has a fixed number of rows, so what follows the grouping (running sums, cut-offs) is small whatever the volume's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import written


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, for what is dear and read by several jobs (a range first, then the counts)."""
    return written(df, name)


def value_range(voxels: DataFrame, value: str = "u") -> DataFrame:
    return voxels.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def positive_range(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Of values above 0 only."""
    v = F.when(F.col(value) > 0, F.col(value))
    return voxels.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """round(bins t - 1/2) clamped to the bins, halves away from zero: which is floor(bins t)."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(bins * F.try_divide(x - lo, hi - lo)).cast("int")))


def jitter_for(jitter: float, bins: int) -> float:
    return jitter if jitter * jitter < 0.5 / bins else 0.0


def noise(seed: int, axes: tuple[str, ...] = ("n", "row", "col")) -> Column:
    """A number from 0 to 1 (exclusive) for each voxel, made from the seed and its place alone: 32 bits of the md5 of "<seed>:<n>:<row>:<col>"."""
    place = F.concat_ws(":", F.lit(str(seed)), *[F.col(a).cast("string") for a in axes])
    return (F.conv(F.substring(F.md5(place.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def histogram(voxels: DataFrame, bins: int, lo: float | None = None, hi: float | None = None, value: str = "u", jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(bin, count, density, lo, hi) with a row for each bin. The range is the values' own unless given; density divides by all voxels, also those outside it.

    With a jitter, values move by up to half of it either way before they are put in bins, and those less than that from the ends are left out below and above. How a voxel moves follows from
    ``seed`` and its place, so the counts depend on no partitioning.
    """
    x = F.col(value).cast("double")
    if lo is None or hi is None:
        ends = voxels.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("total"))
    else:
        ends = voxels.agg(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.count("*").alias("total"))
    moved = x + F.lit(jitter) * (noise(seed) - 0.5) if jitter else x
    inside = (F.col("lo") - jitter / 2 <= x) & (x + jitter / 2 <= F.col("hi"))
    # One row of ends is joined to all voxels: it is a single row by construction.
    counted = voxels.crossJoin(F.broadcast(ends.select("lo", "hi"))).where(inside).groupBy(bin_of(moved, F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("count"))
    every = voxels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    dense = every.join(F.broadcast(counted), "bin", "left").crossJoin(F.broadcast(ends))
    count = F.coalesce("count", F.lit(0).cast("long"))
    width = (F.col("hi") - F.col("lo")) / bins
    return dense.select("bin", count.alias("count"), F.try_divide(count, F.col("total") * width).alias("density"), "lo", "hi")


def exact_histogram(voxels: DataFrame, value: str = "v", levels: int = 1 << 16) -> DataFrame:
    """(bin, count) of whole numbers below ``levels``, with a row for each."""
    counted = voxels.groupBy(F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    every = voxels.sparkSession.range(levels).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def histogram_table(hist: DataFrame, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(brightness, ch0) for charts, in the scale where lo is 0 and hi is 1; the first and the last bin are left out."""
    x = (F.col("bin") + 0.5) * ((F.lit(hi) - F.lit(lo)) / bins) + F.lit(lo)
    y = F.col("density") * ((F.col("hi") - F.col("lo")) / (F.lit(hi) - F.lit(lo)))
    return hist.where(F.col("bin").between(1, bins - 2)).select(x.alias("brightness"), y.alias("ch0"))


def cumulative(hist: DataFrame, what: str = "count") -> DataFrame:
    """Adds cum, the running sum up to the bin, and total."""
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumns({"cum": F.sum(what).over(every), "total": F.sum(what).over(Window.partitionBy())})


def tail_bins(hist: DataFrame, tail: float, bins: int, what: str = "count") -> DataFrame:
    """(lo, hi): the last bin up to which at most the tail lies (0 if there is none), and the first up to which all but the tail lies (``bins`` if there is none)."""
    c = cumulative(hist, what)
    return c.agg(F.coalesce(F.max(F.when(F.lit(tail) * F.col("total") >= F.col("cum"), F.col("bin"))), F.lit(0)).alias("lo"), F.coalesce(F.min(F.when(F.lit(1.0 - tail) * F.col("total") <= F.col("cum"), F.col("bin"))), F.lit(bins)).alias("hi"))


def tail_values(hist: DataFrame, tail: float, bins: int) -> DataFrame:
    """(lo, hi): the same as left edges of bins, where the densities are to reach the tail over the bin width."""
    c = hist.withColumn("_w", (F.col("hi") - F.col("lo")) / bins)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("cum", F.sum("density").over(every))
    low, width = F.first("lo"), F.first("_w")
    return c.agg(
        (F.coalesce(F.max(F.when(F.lit(tail) / F.col("_w") >= F.col("cum"), F.col("bin"))), F.lit(0)) * width + low).alias("lo"),
        (F.coalesce(F.min(F.when(F.lit(1.0 - tail) / F.col("_w") <= F.col("cum"), F.col("bin"))), F.lit(bins)) * width + low).alias("hi"),
    )


def upper_tail(hist: DataFrame, tail: float, bins: int) -> DataFrame:
    """(hi): the share of bins before the first one up to which all but the tail lies."""
    return tail_bins(hist, tail, bins, "density").select((F.col("hi") / bins).alias("hi"))


def quantiles(hist: DataFrame, shares: dict[str, float], bins: int) -> DataFrame:
    """One row with the value below which each share lies, linear inside the first occupied bin that reaches it; the ends for shares of 0 and below, 1 and above."""
    c = cumulative(hist)
    out = []
    for name, p in shares.items():
        if p <= 0:
            out.append(F.first("lo").alias(name))
        elif p >= 1:
            out.append(F.first("hi").alias(name))
        else:
            target = F.lit(p) * F.col("total")
            reached = (F.col("count") > 0) & (target <= F.col("cum"))
            inside = (target - (F.col("cum") - F.col("count"))) / F.col("count")
            value = F.col("lo") + (F.col("bin") + inside) * ((F.col("hi") - F.col("lo")) / bins)
            out.append(F.coalesce(F.min_by(F.when(reached, value), F.when(reached, F.col("bin"))), F.first("hi")).alias(name))
    return c.agg(*out)


def joint_histogram(uv: DataFrame, bins: int = 512) -> DataFrame:
    """(vbin, ubin, count) of the occupied cells; u over its range, v over its positive range, all else left out. One grouping after one pass for the ranges."""
    ends = uv.agg(F.min("u").alias("ul"), F.max("u").alias("uh"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("vl"), F.max(F.when(F.col("v") > 0, F.col("v"))).alias("vh"))
    inside = uv.crossJoin(F.broadcast(ends)).where(F.col("u").between(F.col("ul"), F.col("uh")) & F.col("v").between(F.col("vl"), F.col("vh")))
    return inside.groupBy(bin_of(F.col("v"), F.col("vl"), F.col("vh"), bins).alias("vbin"), bin_of(F.col("u"), F.col("ul"), F.col("uh"), bins).alias("ubin")).agg(F.count("*").alias("count"))


def heat_map(joint: DataFrame, bins: int = 512) -> DataFrame:
    """(y, x, level): levels from 0 to 255 of log(count + 1), the rows from the top."""
    top = joint.agg(F.max(F.log1p("count")).alias("top"))
    return joint.crossJoin(F.broadcast(top)).select((F.lit(bins - 1) - F.col("vbin")).alias("y"), F.col("ubin").alias("x"), F.round(F.try_divide(F.log1p("count") * 255.0, F.col("top"))).cast("int").alias("level"))
