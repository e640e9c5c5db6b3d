"""Iterative stencil solvers on overlapping blocks: a round copies each block with a halo, runs as many iterations as the halo allows in numpy, and keeps the inside.

State travels as columns of the voxel table, written to the shared folder after each round; so a block's memory is fixed, however large the volume
or many the iterations, and a lost executor repeats its blocks of one round only. One shuffle a round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("n", "row", "col")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all is one process, a folder of this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """As a Parquet table in the folder that the cluster shares."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voxelgrove/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._voxelgrove_path = path
    return found


def dropped(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read again; any other is left alone."""
    if path := getattr(table, "_voxelgrove_path", None):
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@dataclass
class Dense:
    """A block as arrays over its bounding box; outside of the mask all are 0."""

    inside: np.ndarray
    values: dict[str, np.ndarray]
    #: The voxels that the block keeps; all if None.
    own: np.ndarray | None = None

    def most(self, x: np.ndarray) -> float:
        """The largest value over the voxels that the block keeps."""
        kept = self.inside if self.own is None else self.own
        return float(x[kept].max()) if kept.any() else 0.0

    def has_next(self, axis: int) -> np.ndarray:
        out = np.zeros_like(self.inside)
        a, b = _pair(axis)
        out[a] = self.inside[a] & self.inside[b]
        return out

    def forward(self, x: np.ndarray, axis: int) -> np.ndarray:
        """The next value less this one, 0 where none follows."""
        out = np.zeros_like(x)
        a, b = _pair(axis)
        out[a] = (x[b] - x[a]) * (self.inside[a] & self.inside[b])
        return out

    def backward_part(self, q: np.ndarray, axis: int) -> np.ndarray:
        """Own part where a voxel follows, less that of the one before."""
        a, b = _pair(axis)
        own = q * self.has_next(axis)
        out = own.copy()
        out[b] -= own[a]
        return out * self.inside


def _pair(axis: int) -> tuple[tuple, tuple]:
    a, b = [slice(None)] * 3, [slice(None)] * 3
    a[axis], b[axis] = slice(None, -1), slice(1, None)
    return tuple(a), tuple(b)


def check_block(block: tuple[int, int, int], halo: int) -> None:
    if min(block) < 1 or halo < 1 or any(b < halo for b in block):
        raise ValueError(f"blocks of {block} are too small for a halo of {halo}")


def block_bytes(block: tuple[int, int, int], halo: int, arrays: int) -> int:
    """What the arrays of one block take at eight bytes a number, with the halo."""
    return int(np.prod([b + 2 * halo for b in block])) * 8 * arrays


#: What sending one number of a copied voxel costs, in steps of one iteration over one array's number.
SEND = 12
#: A task's arrays take at most this share of what an executor has for each of its tasks: the rest is for the rows as they come and go.
SHARE = 0.25
MOST_ROUND = 24


@dataclass(frozen=True)
class Plan:
    """block and per_round for a solver; what one block's arrays take; how often a voxel is copied in a round; how many rounds there are."""

    block: tuple[int, int, int]
    per_round: int
    bytes: int
    copies: float
    rounds: int


Box = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]


def bounding_box(voxels: DataFrame) -> Box | None:
    """(first, last) of each axis; None without a voxel."""
    r = voxels.agg(*[f(a) for a in AXES for f in (F.min, F.max)]).first()
    return None if r[0] is None else ((r[0], r[1]), (r[2], r[3]), (r[4], r[5]))


def task_memory(spark: SparkSession) -> int:
    """Bytes that a task's arrays may take: ``SHARE`` of an executor's memory, dealt out to its cores; of the one process's in local mode."""
    conf, local = spark.sparkContext.getConf(), spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    text = (conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g") or "1g").strip().lower().removesuffix("b")
    size = float(text.rstrip("kmgt") or 1) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(text[-1], 1)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", None) or 1)
    return int(size * SHARE / max(1, cores))


def plan_blocks(box: Box, iterations: int, reach: int, more: int, columns: int, arrays: int, memory: int, tasks: int, block: tuple[int, int, int] | None = None, per_round: int | None = None) -> Plan:
    """The cheapest plan for a volume whose iterations look ``reach`` voxels around each, and ``more`` in all.

    A round of k iterations copies each voxel, with its ``columns``, to every block in whose halo of k reach + more it lies, and then works k times on ``arrays`` numbers for each copy. Long rounds are
    few but copy more; large blocks copy less but need memory, and there should be one for each of ``tasks``. For every k the volume is halved along its longest side until both are met.
    Raises ValueError if no plan fits.
    """
    size = [hi - lo + 1 for lo, hi in box]
    found: list[tuple[float, Plan]] = []
    for k in [per_round] if per_round else range(1, min(MOST_ROUND, max(1, iterations)) + 1):
        halo = max(1, k * reach + more)
        own = list(block or (max(x, halo) for x in size))

        def needs(b: list[int], halo: int = halo) -> int:
            # No block holds more than the volume.
            return int(np.prod([min(x, e + 2 * halo) for e, x in zip(b, size, strict=True)])) * 8 * arrays

        def number(b: list[int]) -> int:
            return int(np.prod([-(-x // e) for e, x in zip(b, size, strict=True)]))

        while block is None and (needs(own) > memory or number(own) < tasks):
            axis = max((j for j in range(3) if -(-own[j] // 2) >= max(halo, 4)), key=lambda j: own[j], default=None)
            if axis is None:
                break
            own[axis] = -(-own[axis] // 2)
        if block is None and needs(own) > memory:
            continue
        spread = [sum(min(hi, (i + 1) * e - 1 + halo) - max(lo, i * e - halo) + 1 for i in range(lo // e, hi // e + 1)) / x for e, x, (lo, hi) in zip(own, size, box, strict=True)]
        copies, rounds = float(np.prod(spread)), -(-iterations // k)
        found.append((rounds * copies * (SEND * columns + k * arrays), Plan(tuple(own), k, needs(own), copies, rounds)))
    if not found:
        raise ValueError(f"no block of a volume of {size} fits into {memory} bytes with a halo of {reach + more}: give executors more memory or fewer cores")
    return min(found, key=lambda x: x[0])[1]


def run_round(state: DataFrame, columns: list[str], step: Callable[[Dense], dict[str, np.ndarray]], block: tuple[int, int, int], halo: int, out: list[str], box: Box | None = None) -> DataFrame:
    """Voxels (n, row, col, ``out``) after ``step``, which may look as far as ``halo`` voxels around.

    A voxel goes to its own block and to those in whose halo it lies: at most 27, and (1 + 2 halo / block)^3 on average. What ``step`` gives as "trace", one number for each iteration over
    the voxels that the block keeps, comes along as the column ``trace`` of one of them; see ``trace_of``. With the volume's ``box``, no voxel is copied to a block beyond it.
    """
    check_block(block, halo)
    keyed = state.select(*AXES, *columns)
    for k, (axis, size) in enumerate(zip(AXES, block, strict=True)):
        own = F.floor(F.col(axis) / size)
        low, high = F.floor((F.col(axis) - halo) / size), F.floor((F.col(axis) + halo) / size)
        if box is not None:
            low, high = F.greatest(low, F.lit(box[k][0] // size)), F.least(high, F.lit(box[k][1] // size))
        keyed = keyed.withColumn(f"_b_{axis}", F.explode(F.sequence(low.cast("int"), high.cast("int")))).withColumn(f"_o_{axis}", own.cast("int"))
    own = (F.col("_b_n") == F.col("_o_n")) & (F.col("_b_row") == F.col("_o_row")) & (F.col("_b_col") == F.col("_o_col"))
    keyed = keyed.withColumn("_own", own).drop("_o_n", "_o_row", "_o_col")

    def solve(table: pa.Table) -> pa.Table:
        mine = table.column("_own").to_numpy(zero_copy_only=False)
        if not mine.any():
            return pa.table({c: pa.array([], pa.int32()) for c in AXES} | {c: pa.array([], pa.float64()) for c in out} | {"trace": pa.array([], pa.list_(pa.float64()))})
        at = [table.column(c).to_numpy() for c in AXES]
        low = [int(a.min()) for a in at]
        shape = tuple(int(a.max()) - lo + 1 for a, lo in zip(at, low, strict=True))
        index = tuple(a - lo for a, lo in zip(at, low, strict=True))
        inside = np.zeros(shape, bool)
        inside[index] = True
        values = {}
        for c in columns:
            values[c] = np.zeros(shape)
            values[c][index] = table.column(c).to_numpy()
        places = tuple(i[mine] for i in index)
        own = np.zeros(shape, bool)
        own[places] = True
        result = step(Dense(inside, values, own))
        trace = pa.array([list(map(float, result.get("trace", [])))] + [None] * (int(mine.sum()) - 1), pa.list_(pa.float64()))
        return pa.table({c: pa.array(a[mine].astype(np.int32)) for c, a in zip(AXES, at, strict=True)} | {c: pa.array(result[c][places]) for c in out} | {"trace": trace})

    schema = "n int, row int, col int, " + ", ".join(f"{c} double" for c in out) + ", trace array<double>"
    return keyed.groupBy("_b_n", "_b_row", "_b_col").applyInArrow(solve, schema)


def trace_of(state: DataFrame) -> list[float]:
    """The largest number of each iteration of the round over all blocks: as many numbers as the round has iterations."""
    each = state.where(F.col("trace").isNotNull()).select(F.posexplode("trace").alias("k", "x"))
    return [r.x for r in each.groupBy("k").agg(F.max("x").alias("x")).orderBy("k").collect()]


def trace_table(spark: SparkSession, squares: list[float]) -> DataFrame:
    """(iter, maxdeltaq): the largest change of a voxel in each iteration, from its squares."""
    return spark.createDataFrame([(k, x**0.5) for k, x in enumerate(squares)], "iter int, maxdeltaq double")
