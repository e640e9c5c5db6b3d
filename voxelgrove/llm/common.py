"""What several operators share: the shared scratch folder, written intermediate tables, bounded samples, and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, so that numpy's temporaries stay small whatever an Arrow batch holds.
SLICE_BYTES = 1 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A session without one may only run in one process, where a folder of this machine is as good."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{scratch(spark)}/voxelgrove/{uuid.uuid4().hex}/{name}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path (local, hdfs, s3, gs, abfs), and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, run_folder(df.sparkSession, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._voxelgrove_path = path
    return found


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_voxelgrove_path", None):
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's text is a multiple of five; a null id counts as empty text, so it is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, keys: list[str], most: int, seed: int = 17) -> DataFrame:
    """At most ``most`` rows with the lowest hash of ``keys``: the same ones for the same rows, in any order or partitioning.

    Only rows under a threshold (about twice ``most``) reach the final top-``most``, so no task holds more than a small multiple of the bound.
    """
    total = df.count()
    rank = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(seed)).bitwiseAND(F.lit((1 << 32) - 1))
    ranked = df.withColumn("_rank", rank)
    if total > 2 * most:
        ranked = ranked.where(F.col("_rank") < int((1 << 32) * min(1.0, 2.0 * most / total)))
    return ranked.orderBy("_rank", *keys).limit(most).drop("_rank")


def within_bytes(df: DataFrame, order: list[str], size: Column, most: int) -> DataFrame:
    """The rows of ``df`` with the lowest hashes of ``order`` whose sizes sum to ``most`` bytes at the most; rows of one hash stay or go together.

    Where to stop is found from sums over 4,096 ranges of hashes, then over parts of the range in which the bound is passed, down to one hash: the driver never holds more.
    """
    ranked = df.withColumn("_h", F.xxhash64(*[F.col(c).cast("string") for c in order], F.lit(29)))
    part, seen, step = ranked.select("_h", size.cast("long").alias("_n")), 0, 64
    while step:
        step = max(0, step - 12)
        place = F.shiftright("_h", step)
        for at, n in sorted((r[0], r[1] or 0) for r in part.groupBy(place).agg(F.sum("_n")).collect()):
            if seen + n > most:
                break
            seen += n
        else:
            return ranked.drop("_h")
        part = part.where(place == at)
    return ranked.where(F.col("_h") < at).drop("_h")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text has a range of its own."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def by_slice(work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None], text: str) -> Callable:
    """For ``mapInArrow``: calls ``work`` with a slice of rows, the bytes of its ``text`` column and the offsets (from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(at):
                out = work(batch.slice(a, b - a), raw[at[a] : at[b]], at[a : b + 1] - at[a])
                if out is not None and out.num_rows:
                    yield out

    return run


def for_python(docs: DataFrame, cols: list[str], text: str, more: list[Column] | None = None) -> tuple[DataFrame, list[str]]:
    """What a Python stage reads, the text last and sent once, as ``_text``; and the columns of ``cols`` that it hands back, of which the text too is last."""
    others = [c for c in cols if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], *(more or []), F.col(f"`{text}`").alias("_text"))
    return rows, [*others, *([text] if text in cols else [])]


def handed_back(batch: pa.RecordBatch, back: list[str], text: str) -> list[pa.Array]:
    """The columns named by ``for_python``, of a batch or a slice of it."""
    n = len(back) - (text in back)
    return [*batch.columns[:n], *([batch.column(batch.num_columns - 1)] if text in back else [])]


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
