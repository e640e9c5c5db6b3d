"""Blank-separated tables with a header line, as charts read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...] = ("intensity", "ch0")) -> DataFrame:
    """Numbers by column; the header's own names ("brightness" or "intensity") are replaced by ``columns``."""
    schema = ", ".join(f"{c} double" for c in columns)
    return spark.read.csv(path, sep=" ", header=True, schema=schema, enforceSchema=True, mode="FAILFAST")


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, sep=" ", header=True)
