"""Pictures and grids as tables, and grids as VTK image files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.voxel import byte_level, grey_level


def slice_picture(voxels: DataFrame, col: int, value: str = "u") -> DataFrame:
    """(n, row, level) of one column; a volume sorted by column is read for that column only."""
    return voxels.where(F.col("col") == col).select("n", "row", grey_level(F.col(value)).cast("int").alias("level"))


def image_grid(voxels: DataFrame, images: int, value: str = "u") -> DataFrame:
    """(n, row, col, level) for every place of the mask's bounding box, 255 outside of the mask: three small ranges are joined, then the voxels by key."""
    box = voxels.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    # The box is one row; its columns are dealt out before they become lines.
    grid = box.select(F.explode(F.sequence("c0", "c1")).alias("col"), "r0", "r1").repartition("col").select(F.explode(F.sequence("r0", "r1")).alias("row"), "col")
    grid = grid.select(F.explode(F.sequence(F.lit(0), F.lit(images - 1))).alias("n"), "row", "col")
    levels = voxels.select("n", "row", "col", byte_level(F.col(value)).cast("int").alias("level"))
    return grid.join(levels, ["n", "row", "col"], "left").select("n", "row", "col", F.coalesce("level", F.lit(255)).alias("level"))


def grid_lines(grid: DataFrame) -> DataFrame:
    """(col, row, bytes): each line along n as bytes, in the order that image files want when sorted by col and row."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("n", "level"))), lambda x: F.lpad(F.hex(x["level"]), 2, "0"))
    return grid.groupBy("col", "row").agg(F.unhex(F.array_join(line, "")).alias("bytes"))


def _vtk_head(images: int, rows: int, cols: int) -> bytes:
    """Fixed text of the format, up to and with the number of bytes that follow: 4 bytes, or 8 where they need it."""
    size = images * rows * cols
    wide = ' header_type="UInt64"' if size >= 1 << 32 else ""
    ends = f"0 {images - 1} 0 {rows - 1} 0 {cols - 1}"
    lines = [
        '<?xml version="1.0"?>', f'<VTKFile type="ImageData" byte_order="LittleEndian"{wide}>', f'  <ImageData WholeExtent="{ends}">', f'    <Piece Extent="{ends}">', '      <PointData Scalars="labels">',
        '        <DataArray type="UInt8" Name="labels" format="appended" offset="0"/>', "      </PointData>", "    </Piece>", "  </ImageData>", '  <AppendedData encoding="raw">', "_",
    ]
    return "\n".join(lines).encode() + struct.pack("<Q" if wide else "<I", size)


_VTK_END = b"\n  </AppendedData>\n</VTKFile>\n"


def _place(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: parts of one file can be written by many tasks only in a file system that the executors share")
    return path.removeprefix("file://").removeprefix("file:")


def write_vtk(voxels: DataFrame, path: str, images: int, value: str = "u") -> tuple[int, int, int]:
    """Writes the mask's bounding box as a VTK image of bytes, 255 outside of the mask: n runs fastest, then row, then col. Returns images, rows and columns.

    The file lies in a file system that driver and executors share. The driver lays out head, length and end; each column of the volume has its own place in the file, where the task that holds it
    writes, so tasks don't wait for each other and one that is run again writes the same. Raises ValueError if there is no voxel.
    """
    box = voxels.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if box.r0 is None:
        raise ValueError("there is no voxel to write")
    rows, cols, place = box.r1 - box.r0 + 1, box.c1 - box.c0 + 1, _place(path)
    head = _vtk_head(images, rows, cols)
    with open(place, "wb") as f:
        f.write(head)
        f.truncate(len(head) + images * rows * cols)
        f.seek(0, 2)
        f.write(_VTK_END)

    def write(table: pa.Table) -> pa.Table:
        col = int(table.column("col")[0].as_py())
        known = table.filter(table.column("n").is_valid())
        lines = np.full((rows, images), 255, np.uint8)
        lines[known.column("row").to_numpy() - box.r0, known.column("n").to_numpy()] = known.column("level").to_numpy()
        with open(place, "r+b") as f:
            f.seek(len(head) + (col - box.c0) * rows * images)
            f.write(lines.tobytes())
        return pa.table({"col": pa.array([col], pa.int32())})

    levels = voxels.select("n", "row", "col", byte_level(F.col(value)).cast("int").alias("level"))
    # A row more for each column, so that one without a voxel is written too.
    every = voxels.sparkSession.range(box.c0, box.c1 + 1).select(F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("row"), F.col("id").cast("int").alias("col"), F.lit(None).cast("int").alias("level"))
    levels.unionByName(every).groupBy("col").applyInArrow(write, "col int").write.format("noop").mode("overwrite").save()
    return images, rows, cols


def read_vtk(spark: SparkSession, path: str) -> DataFrame:
    """(col, row, bytes) of a file of ``write_vtk``, col and row from 0; a task reads the places of some columns."""
    place = _place(path)
    with open(place, "rb") as f:
        start = f.read(1024)
    images, rows, cols = (int(x) + 1 for x in re.search(rb'WholeExtent="0 (\d+) 0 (\d+) 0 (\d+)"', start).groups())
    begin = len(_vtk_head(images, rows, cols))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(place, "rb") as f:
            for b in batches:
                for col in b.column(0).to_pylist():
                    f.seek(begin + col * rows * images)
                    data = f.read(rows * images)
                    yield pa.RecordBatch.from_arrays([pa.array([col] * rows, pa.int32()), pa.array(range(rows), pa.int32()), pa.array([data[k * images : (k + 1) * images] for k in range(rows)])], ["col", "row", "bytes"])

    return spark.range(cols).mapInArrow(read, "col int, row int, bytes binary")
