"""Phases: labels by voxel, statistics by label, alignment of raw and denoised volumes, sampling, fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.voxel import check_labels, nearest_label

KEY = ["n", "row", "col"]
#: A multiplicative hash that other engines can repeat.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxels of both volumes at the same place. Better to compute a derived value as a column of the first and need no join."""
    return a.join(b, KEY)


def label_table(spark, labels: list[float]) -> DataFrame:
    """(k, c): 2 to 6 rows."""
    return spark.createDataFrame(list(enumerate(check_labels(labels))), "k int, c double")


def label_pairs(labels: DataFrame) -> DataFrame:
    """(i, j, c_i, c_j) for i < j: at most 15 rows."""
    a, b = labels.select(F.col("k").alias("i"), F.col("c").alias("c_i")), labels.select(F.col("k").alias("j"), F.col("c").alias("c_j"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j"))


def data_terms(voxels: DataFrame, labels: DataFrame, weight: float, value: str = "u") -> DataFrame:
    """(n, row, col, k, term): the cost of each label at each voxel; the labels are a few rows."""
    d = F.col(value) - F.col("c")
    return voxels.crossJoin(F.broadcast(labels)).select(*KEY, "k", (F.lit(weight) * d * d).alias("term"))


def denoised_by_mean(voxels: DataFrame, value: str = "u") -> DataFrame:
    """(n, row, col, d): the mean of each voxel and its neighbours along n."""
    w = Window.partitionBy("row", "col").orderBy("n").rowsBetween(-1, 1)
    return voxels.select(*KEY, F.avg(value).over(w).alias("d"))


def statistics_by_label(raw: DataFrame, denoised: DataFrame, labels: list[float]) -> DataFrame:
    """(label, count, mean, variance, fraction) of raw values, labelled by the denoised value at the same place; the variance of a single voxel is 0."""
    return _statistics(align(raw, denoised).withColumn("label", nearest_label(F.col("d"), labels)), "label")


def statistics_by_cluster(raw: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, count, mean, variance, fraction) of raw values by the cluster (n, row, col, cluster) at the same place."""
    return _statistics(align(raw, clusters), "cluster")


def _statistics(voxels: DataFrame, by: str) -> DataFrame:
    found = voxels.groupBy(by).agg(F.count("*").alias("count"), F.avg("u").alias("mean"), F.coalesce(F.var_samp("u"), F.lit(0.0)).alias("variance"))
    return found.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy()))


def fractions(voxels: DataFrame, labels: list[float], value: str = "u") -> DataFrame:
    """(label, count, fraction)."""
    by = voxels.groupBy(nearest_label(F.col(value), labels).alias("label")).agg(F.count("*").alias("count"))
    return by.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy()))


def porosity(by_label: DataFrame, solid: int, fluid: int) -> DataFrame:
    """One row: the share of all but the solid phase, and of the fluid in that."""
    total, pores = F.sum("count"), F.sum(F.when(F.col("label") != solid, F.col("count")).otherwise(0))
    return by_label.agg((pores / total).alias("porosity"), (F.sum(F.when(F.col("label") == fluid, F.col("count")).otherwise(0)) / pores).alias("saturation"))


def mixture_fractions(weights: list[float], k: int) -> list[float]:
    """Volume fractions of the phases from the weights of pure parts and interfaces: an interface is half of either."""
    out, at = list(weights[:k]), k
    for i in range(k - 1):
        for j in range(i + 1, k):
            out[i] += weights[at] / 2
            out[j] += weights[at] / 2
            at += 1
    return out


def sample_batches(voxels: DataFrame, key, size: int, batch: int) -> DataFrame:
    """``size`` voxels without replacement in the order of a hash of their key, dealt into batches of ``batch``; the same for the same key.

    The sample's size is a fixed parameter, so ranking it is bounded work.
    """
    drawn = voxels.withColumn("h", (key * MULTIPLIER) % MODULUS).orderBy("h").limit(size)
    rank = F.row_number().over(Window.orderBy("h")) - 1
    return drawn.withColumn("batch", F.floor(rank / batch).cast("int"))


def require_samples(n: int, least: int) -> None:
    if n < least:
        raise ValueError(f"{least} samples are asked for; there are {n}")
