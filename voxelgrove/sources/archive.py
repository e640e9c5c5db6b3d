"""Binary field archives: a bit stream, high bit first, of the cylinder's layout, the calibration and the voxels by column, row and image.

Unsigned numbers of the layout are exponential-Golomb codes; the first rows of all the picture's columns, and their bases with the total, are coded as the first value and signed differences. As the
layout's length is any number of bits, the voxels' bytes are shifted by the same few bits throughout. ``write_archive`` and ``read_archive`` give every column's voxels their own place in one file,
which many tasks write or read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, bits: int) -> int:
        """Beyond the end all bits are 0."""
        first, last = self.at // 8, (self.at + bits + 7) // 8
        chunk = self.data[first:last].ljust(last - first, b"\0")
        self.at += bits
        return (int.from_bytes(chunk, "big") >> (last * 8 - self.at)) & ((1 << bits) - 1)

    def unsigned(self) -> int:
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros > 64:
                raise ValueError("the code has no end")
        return (1 << zeros | self.read(zeros)) - 1 if zeros else 0

    def signed(self) -> int:
        k = self.unsigned()
        return (k + 1) // 2 if k % 2 else -(k // 2)


class BitWriter:
    def __init__(self):
        self.whole, self.rest, self.bits = bytearray(), 0, 0  # full bytes, and the bits after them

    def write(self, x: int, bits: int) -> None:
        value, n = (self.rest << bits) | (x & ((1 << bits) - 1)), self.bits + bits
        self.bits = n % 8
        self.whole += (value >> self.bits).to_bytes(n // 8, "big")
        self.rest = value & ((1 << self.bits) - 1)

    def array(self, values: np.ndarray) -> None:
        """All bits of an array's numbers, high byte first: shifted as bytes, not number by number."""
        raw = np.frombuffer(values.astype(values.dtype.newbyteorder(">")).tobytes(), np.uint8)
        if self.bits and len(raw):
            joined = np.concatenate([np.array([self.rest << (8 - self.bits)], np.uint16), raw.astype(np.uint16) << (8 - self.bits)])
            self.whole += ((joined[:-1] & 0xFF) | (joined[1:] >> 8)).astype(np.uint8).tobytes()
            self.rest = int(raw[-1]) & ((1 << self.bits) - 1)
        else:
            self.whole += raw.tobytes()

    def unsigned(self, x: int) -> None:
        n = (x + 1).bit_length()
        self.write(0, n - 1)
        self.write(x + 1, n)

    def signed(self, x: int) -> None:
        self.unsigned(2 * x - 1 if x > 0 else -2 * x)

    def bytes(self) -> bytes:
        return bytes(self.whole) + (bytes([self.rest << (8 - self.bits)]) if self.bits else b"")


#: Fixed value: the first row of a column that the cylinder does not reach.
NO_ROW = (1 << 32) - 1


def unshifted(data: bytes, shift: int, count: int, kind: str) -> np.ndarray:
    """``count`` numbers that begin ``shift`` bits after the first byte; missing bytes are 0."""
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data[: count * size + 1].ljust(count * size + 1, b"\0"), np.uint8)
    if shift:
        raw = ((raw[:-1].astype(np.uint16) << shift) | (raw[1:] >> (8 - shift))).astype(np.uint8)
    return np.frombuffer(raw[: count * size].tobytes(), np.dtype(kind).newbyteorder(">")).astype(kind)


@dataclass
class Field:
    """spans: by column from ``col_begin``, first row and row after the last; values: spans' rows x images, one after the other."""

    images: int
    height: int
    width: int
    col_begin: int
    spans: list[tuple[int, int]]
    values: np.ndarray
    lo: float = 0.0
    hi: float = 1.0

    def stride(self) -> int:
        per = 128 // self.values.dtype.itemsize
        return -(-self.images // per) * per

    def encode(self) -> bytes:
        w = self.head()
        w.array(self.values)
        return w.bytes()

    def head(self) -> BitWriter:
        """All that comes before the voxels."""
        w = BitWriter()
        for x in (self.images, self.height, self.width, self.stride(), self.col_begin, self.col_begin + len(self.spans)):
            w.unsigned(x)
        # Every column of the picture has an entry, also those that the cylinder does not reach.
        none, end = (NO_ROW, NO_ROW), self.col_begin + len(self.spans)
        every = [none] * self.col_begin + [(a, b) if a < b else none for a, b in self.spans] + [none] * (self.width - end)
        starts = [a for a, _ in every]
        base, bases = 0, []
        for a, b in every:
            bases.append(base)
            base += (b - a) * self.stride()
        bases.append(base)
        for numbers in (starts, bases):
            w.unsigned(len(numbers))
            for k, x in enumerate(numbers):
                w.signed(x - numbers[k - 1]) if k else w.unsigned(x)
        floating = self.values.dtype.kind == "f"
        if floating:
            for x in (self.lo, self.hi):
                w.write(int(np.float32(x).view(np.uint32)), 32)
        return w

    @classmethod
    def opened(cls, data: bytes, kind: str = "f4") -> tuple[Field, int]:
        """The layout and calibration, without a voxel, and the bit at which the voxels begin."""
        r = BitReader(data)
        images, height, width, stride, begin, end = (r.unsigned() for _ in range(6))
        lists = []
        for _ in range(2):
            count, numbers = r.unsigned(), []
            for k in range(count):
                numbers.append(numbers[-1] + r.signed() if k else r.unsigned())
            lists.append(numbers)
        starts, bases = lists
        spans = [(starts[k], starts[k] + (bases[k + 1] - bases[k]) // stride) for k in range(begin, end)]
        lo, hi = 0.0, 1.0
        if np.dtype(kind).kind == "f":
            lo, hi = (float(np.uint32(r.read(32)).view(np.float32)) for _ in range(2))
        return cls(images, height, width, begin, spans, np.zeros(0, kind), lo, hi), r.at

    @classmethod
    def decode(cls, data: bytes, kind: str = "f4") -> Field:
        field, at = cls.opened(data, kind)
        count = sum(b - a for a, b in field.spans) * field.images
        field.values = unshifted(data[at // 8 :], at % 8, count, kind)
        return field

    def voxels(self) -> pd.DataFrame:
        lines = [(row, self.col_begin + k) for k, (a, b) in enumerate(self.spans) for row in range(a, b)]
        row, col = (np.repeat([x[i] for x in lines], self.images).astype(np.int32) for i in (0, 1))
        return pd.DataFrame({"n": np.tile(np.arange(self.images, dtype=np.int32), len(lines)), "row": row, "col": col, "u": self.values.astype(np.float64)})


def read_archives(spark: SparkSession, path: str, kind: str = "f4") -> DataFrame:
    """(path, n, row, col, u) of all archives at ``path``; each file is decoded by one task, which suits one file per slab of columns."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                yield Field.decode(bytes(content), kind).voxels().assign(path=name)[["path", "n", "row", "col", "u"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, n int, row int, col int, u double")


def _place(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: parts of one file can be written or read by many tasks only in a file system that the executors share")
    return path.removeprefix("file://").removeprefix("file:")


def write_archive(voxels: DataFrame, path: str, images: int, height: int, width: int, value: str = "u", lo: float = 0.0, hi: float = 1.0, kind: str = "f4") -> None:
    """Writes the volume as one archive, in the format's own order of bits, to a file system that driver and executors share.

    A row for each column comes to the driver: its rows and the last byte of its last voxel. The driver writes the layout. A task that holds a column shifts its bytes by the bits that the
    layout leaves over, beginning with what the column before left, and writes them at their place; one that is run again writes the same. Raises ValueError if a column has gaps.
    """
    place, number = _place(path), np.dtype(kind)
    last = F.max_by(F.col(value), F.struct("row", "n")).alias("last")
    found = voxels.groupBy("col").agg(F.min("row").alias("a"), (F.max("row") + 1).alias("b"), F.count("*").alias("count"), last).orderBy("col").collect()
    if not found:
        raise ValueError("there is no voxel to write")
    begin, end = found[0]["col"], found[-1]["col"] + 1
    if len(found) != end - begin or any(r["count"] != (r["b"] - r["a"]) * images for r in found):
        raise ValueError("a column of the volume has gaps")
    head = Field(images, height, width, begin, [(r["a"], r["b"]) for r in found], np.zeros(0, kind), lo, hi).head()
    shift, first = head.bits, len(head.whole)
    carry, at, plan = head.rest, first, {}
    for r in found:
        plan[r["col"]] = (at, carry)
        at += r["count"] * number.itemsize
        carry = np.array(r["last"], number.newbyteorder(">")).tobytes()[-1]
    with open(place, "wb") as f:
        f.write(bytes(head.whole))
        f.truncate(at + (shift > 0))

    def write(table: pa.Table) -> pa.Table:
        col = int(table.column("col")[0].as_py())
        order = np.lexsort((table.column("n").to_numpy(), table.column("row").to_numpy()))
        raw = np.frombuffer(table.column("u").to_numpy()[order].astype(number.newbyteorder(">")).tobytes(), np.uint8)
        start, before = plan[col]
        if shift:
            whole = np.concatenate([np.array([before], np.uint8), raw, np.zeros(int(col == end - 1), np.uint8)])
            raw = ((whole[:-1].astype(np.uint16) << (8 - shift)) & 0xFF | whole[1:] >> shift).astype(np.uint8)
        with open(place, "r+b") as f:
            f.seek(start)
            f.write(raw.tobytes())
        return pa.table({"col": pa.array([col], pa.int32())})

    voxels.select("n", "row", "col", F.col(value).alias("u")).groupBy("col").applyInArrow(write, "col int").write.format("noop").mode("overwrite").save()


def read_archive(spark: SparkSession, path: str, kind: str = "f4") -> tuple[DataFrame, Field]:
    """(n, row, col, u) of one archive, its columns read by many tasks, each from their own place; and its layout and calibration. A task holds one column."""
    place = _place(path)
    with open(place, "rb") as f:
        # Entries of the layout take at most 65 bits each, two for each column of the picture.
        start = f.read(1 << 12)
        r = BitReader(start)
        width = [r.unsigned() for _ in range(3)][2]
        field, at = Field.opened(start + f.read(17 * (width + 8)), kind)
    size, places, begin = np.dtype(kind).itemsize, [], at // 8
    for k, (a, b) in enumerate(field.spans):
        places.append((field.col_begin + k, a, b, begin))
        begin += (b - a) * field.images * size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(place, "rb") as f:
            for batch in batches:
                for col, a, b, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.seek(begin)
                    count = (b - a) * field.images
                    values = unshifted(f.read(count * size + 1), at % 8, count, kind)
                    n, row = np.tile(np.arange(field.images, dtype=np.int32), b - a), np.repeat(np.arange(a, b, dtype=np.int32), field.images)
                    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(row), pa.array(np.full(count, col, np.int32)), pa.array(values.astype(np.float64))], ["n", "row", "col", "u"])

    # A row for each column.
    columns = spark.createDataFrame([x for x in places if x[1] < x[2]], "col int, a long, b long, begin long")
    parts = max(1, min(len(places), spark.sparkContext.defaultParallelism * 4))
    return columns.repartition(parts, "col").mapInArrow(read, "n int, row int, col int, u double"), field


def archive_slabs(voxels: DataFrame, images: int, height: int, width: int, slab: int, value: str = "u", lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(slab, content): an archive for each ``slab`` columns of a volume whose rows are contiguous in every column."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["col", "row", "n"])
        spans = pdf.groupby("col").row.agg(["min", "max"])
        begin, end = int(spans.index.min()), int(spans.index.max())
        rows = [(int(spans["min"].get(c, 0)), int(spans["max"].get(c, -1)) + 1) for c in range(begin, end + 1)]
        content = Field(images, height, width, begin, rows, pdf[value].to_numpy(np.float32), lo, hi).encode()
        return pd.DataFrame({"slab": [int(pdf.slab.iloc[0])], "content": [content]})

    return voxels.withColumn("slab", F.floor(F.col("col") / slab).cast("int")).groupBy("slab").applyInPandas(encode, "slab int, content binary")
