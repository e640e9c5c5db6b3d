"""Volumes as voxel tables (n, row, col, value), made from the given tables by closed-form indices, and the rod form of a volume."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def square_side(spark: SparkSession, sf_dir: str) -> int:
    """The side of the square cross-section of the embeddings' volume: the root of their number, rounded down. The number is read off the files' footers."""
    return max(1, isqrt(spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()))


def embedding_volume(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """(n, row, col, u): the elements of an embedding lie along n; rows and columns both grow with the table."""
    rows = rows or square_side(spark, sf_dir)
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("n", "u"))
    return vec.select("n", (F.col("vec_id") % rows).cast("int").alias("row"), F.expr(f"vec_id div {rows}").cast("int").alias("col"), F.col("u").cast("double").alias("u"))


def cube_side(spark: SparkSession, sf_dir: str) -> int:
    """The cube root of the number of events, rounded."""
    return max(1, int(spark.read.parquet(f"{sf_dir}/events.parquet").count() ** (1 / 3) + 0.5))


def event_volume(spark: SparkSession, sf_dir: str, side: int | None = None) -> DataFrame:
    """(n, row, col, u) of the events' values; all three axes grow with the table."""
    side = side or cube_side(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(*_indices("event_id", side, side), F.col("value").cast("double").alias("u"))


def order_volume(spark: SparkSession, sf_dir: str, images: int = 25, rows: int = 20) -> DataFrame:
    """(n, row, col, v) of whole numbers below 65536."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(*_indices("o_orderkey", images, rows), F.floor(F.col("o_totalprice") / 10).cast("int").alias("v"))


def _indices(key: str, images: int, rows: int) -> list:
    return [F.expr(f"{key} % {images}").cast("int").alias("n"), F.expr(f"({key} div {images}) % {rows}").cast("int").alias("row"), F.expr(f"{key} div {images * rows}").cast("int").alias("col")]


def rods(voxels: DataFrame, value: str = "u") -> DataFrame:
    """(row, col, n_first, vals): one row for each line along n, in order of n; the axis transpose of a stack of pages."""
    line = F.array_sort(F.collect_list(F.struct("n", F.col(value).alias("x"))))
    return voxels.groupBy("row", "col").agg(line.alias("line")).select("row", "col", F.col("line")[0]["n"].alias("n_first"), F.col("line.x").alias("vals"))


def from_rods(rod: DataFrame, value: str = "u") -> DataFrame:
    return rod.select("row", "col", "n_first", F.posexplode("vals").alias("k", value)).select((F.col("n_first") + F.col("k")).alias("n"), "row", "col", value)


def linear_ids(voxels: DataFrame, images: int) -> DataFrame:
    """Adds ``id``, the place in the order (col, row, n) among the mask's voxels: from the spans' running sizes, so that no global sort is needed.

    Each span has all ``images`` voxels along n; the number of spans is the area of the cross-section, not the number of voxels.
    """
    from pyspark.sql import Window

    spans = voxels.groupBy("col").agg(F.min("row").alias("row_begin"), (F.max("row") + 1).alias("row_end"))
    before = Window.orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.withColumn("base", F.coalesce(F.sum((F.col("row_end") - F.col("row_begin")) * images).over(before), F.lit(0)))
    joined = voxels.join(F.broadcast(base), "col")  # a row for each column of the cross-section: at most its width
    return joined.withColumn("id", (F.col("base") + (F.col("row") - F.col("row_begin")) * images + F.col("n")).cast("long")).drop("base", "row_begin", "row_end")


def save_aligned(voxels: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Saves a volume as a table in buckets of its voxels' places, sorted, so that volumes saved with the same number of buckets are joined by place without a shuffle. Returns the table.

    Rows are dealt out by place first: a bucket is one file. ``buckets`` should be such that one holds some 100 MB. The files lie in the warehouse, or at ``path``.
    """
    place = ("col", "row", "n")
    voxels.repartition(buckets, *place).write.mode("overwrite").bucketBy(buckets, *place).sortBy(*place).saveAsTable(table, **({"path": path} if path else {}))
    return voxels.sparkSession.table(table)
