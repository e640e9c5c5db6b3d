"""Centroid clustering in whole numbers, with Orchard's search for the nearest centroid.

Every centroid has a list of the others, nearest first. A search stands at one centroid, goes along its list, jumps to the list of a closer one as soon as it meets it,
never measures a centroid twice, and stops at the first one that lies strictly farther from where it stands than twice the present distance: by the triangle inequality nothing
beyond is as near. One exactly at twice the distance may tie, so it is still measured. All of it is exact, as components and squared distances are whole numbers.

The vectors are turned into whole numbers once and written with their nearest first centroid, where each later search begins. A round reads that table and
sends one row of sums for each centroid and task; no vector is shuffled. The driver holds the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

CENTROIDS, ROUNDS, SEED, SCALE, DIM = 8, 10, 3, 1024, 64
#: The lists take 12 bytes for each pair of centroids in every task.
MOST_CENTROIDS = 4096
#: Vectors are searched for in slices of so many, so that temporaries stay at a few MB.
ROWS = 4096
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def limit(dim: int) -> int:
    """The largest size of a component with which every squared distance is below 2**62."""
    return isqrt((1 << 62) // dim) // 2


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the other ones, nearest first and smaller numbers first among equals; and the largest distance at which each is out of reach: gap > 4 d is reach >= d."""
    k = len(centroids)
    lists, reach = np.zeros((k, k - 1), np.int32), np.zeros((k, k - 1), np.int64)
    for i, c in enumerate(centroids):
        gap = ((centroids - c) ** 2).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        order = order[order != i]
        lists[i], reach[i] = order, (gap[order] - 1) >> 2
    return lists, reach


def orchard(x: np.ndarray, centroids: np.ndarray, lists: np.ndarray, reach: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of ``x`` (the smaller number among equals), its squared distance, and how many distances it took."""
    n, k = len(x), len(centroids)
    best = start.astype(np.int64)
    d = ((x - centroids[best]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), best] = True
    at, live, measured = np.zeros(n, np.int64), np.arange(n if k > 1 else 0), n
    while len(live):
        c, p = best[live], at[live]
        within = reach[c, p] < d[live]
        live, near = live[within], lists[c, p][within]
        at[live] += 1
        fresh = ~seen[live, near]
        rows, other = live[fresh], near[fresh]
        seen[rows, other] = True
        e = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
        measured += len(rows)
        closer = (e < d[rows]) | ((e == d[rows]) & (other < best[rows]))
        moved = rows[closer]
        best[moved], d[moved], at[moved] = other[closer], e[closer], 0
        live = live[at[live] < k - 1]
    return best, d, measured


def searched(x: np.ndarray, centroids: np.ndarray, lists: np.ndarray, reach: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``orchard`` slice by slice."""
    best, d = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        s = slice(a, a + ROWS)
        best[s], d[s], _ = orchard(x[s].astype(np.int64), centroids, lists, reach, start[s])
    return best, d


def next_centroids(centroids: np.ndarray, counts: dict[int, int], sums: dict[int, list[int]]) -> np.ndarray:
    """Exact floors of the means; a centroid without vectors stays."""
    return np.array([[s // counts[k] for s in sums[k]] if counts.get(k) else c.tolist() for k, c in enumerate(centroids)], np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    n, width = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x, np.int32))])


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.int32, len(column) * dim, int(edge)).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.int32)


def _prepared(good: DataFrame, keep: list[str], vector: str, centroids: np.ndarray, scale: int) -> DataFrame:
    """``keep``, _x (the components as little-endian 32-bit integers) and _start (the nearest centroid)."""
    most, dim = limit(centroids.shape[1]), centroids.shape[1]
    rows = good.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    schema = rows.drop("_v").select("*", F.lit(b"").alias("_x"), F.lit(0).alias("_start")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, reach = neighbour_lists(centroids)
        for b in batches:
            v = b.column(len(keep))
            for a in range(0, b.num_rows, ROWS):
                flat = v.slice(a, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = np.clip(np.floor(flat * scale), -most, most).astype(np.int32)
                start, _ = searched(x, centroids, lists, reach, np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays([*b.slice(a, len(x)).columns[: len(keep)], _packed(x), pa.array(start, pa.int32())], schema.names)

    return rows.mapInArrow(work, schema)


def _sums(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row for each centroid with vectors: cluster, n, s (sums of the components)."""
    k, dim = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, reach = neighbour_lists(centroids)
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x = _unpacked(b.column(0), dim)
            best, _ = searched(x, centroids, lists, reach, b.column(1).to_numpy())
            for c in np.unique(best):
                own = x[best == c]
                n[c] += len(own)
                s[c] += own.sum(axis=0, dtype=np.int64)
        has = np.flatnonzero(n)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(n[has]), pa.array(s[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    each = table.select("_x", "_start").mapInArrow(work, "cluster int, n long, s array<long>")
    return each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"))


def _assigned(table: DataFrame, keep: list[str], centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]
    schema = table.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, reach = neighbour_lists(centroids)
        for b in batches:
            best, d = searched(_unpacked(b.column(len(keep)), dim), centroids, lists, reach, b.column(len(keep) + 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(best, pa.int32()), pa.array(d)], schema.names)

    return table.mapInArrow(work, schema)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dim: int = DIM, vector: str = "embedding", vec_id: str = "vec_id", keep: list[str] | None = None) -> DataFrame:
    """The vectors of ``dim`` finite components with ``keep`` columns (all but the vector if None), cluster, distance, cluster_inertia, inertia and centroid_sha256.

    A component x is floor(scale x). The first centroids are the k vectors with the smallest sha256 of "<seed>:<id>"; ``rounds`` times each vector goes to its nearest centroid
    (the smaller number among equals) and each centroid with vectors to the floor of their mean; then vectors are assigned once more.

    Defined cases: a null vector, one of another length or with a null, infinite or NaN component is left out; a null id counts as empty text; rows that repeat count each time and, when
    their id is among the smallest, start as several centroids, ordered by vector; with fewer vectors than k there are fewer centroids; an empty table stays empty;
    components beyond ``limit(dim)`` (2**27 for 64) are cut to it, so that distances fit into a long; columns of ``vectors`` named like an added one are replaced.
    """
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"{k} centroids: 1 to {MOST_CENTROIDS} are possible")
    spark = vectors.sparkSession
    cols = [c for c in (keep if keep is not None else [c for c in vectors.columns if c != vector]) if c not in ADDED]
    v = F.col(f"`{vector}`").cast("array<double>")
    good = vectors.where((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{vec_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    first = good.select(h.alias("_h"), v.alias("_v")).orderBy("_h", "_v").limit(k).collect()
    if not first:
        empty = good.select(*[F.col(f"`{c}`") for c in cols])
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(ADDED, ("int", "long", "long", "long", "string"), strict=True)]).where(F.lit(False))
    most = limit(dim)
    centroids = np.array([[max(-most, min(most, floor(x * scale))) for x in r[1]] for r in first], np.int64)
    table = written(_prepared(good, cols, vector, centroids, scale), "vectors")
    for _ in range(rounds):
        found = _sums(table, centroids).collect()
        after = next_centroids(centroids, {r.cluster: r.n for r in found}, {r.cluster: r.s for r in found})
        if (after == centroids).all():
            break  # every further round would give the same ones
        centroids = after
    assigned = written(_assigned(table, cols, centroids), "assigned")
    dropped(table)
    inertia = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    rows = [(c, s, sum(inertia.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    # A row for each centroid.
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select(*[F.col(f"`{c}`") for c in cols], *ADDED)


def op12_orchard_clusters(spark, sf_dir: str) -> DataFrame:
    """Eight clusters of all ``embeddings``."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])


def _sql() -> str:
    squares = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CENTROIDS}))""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT x.vec_id, x.v, min({{'d': CAST({squares} AS BIGINT), 'k': c.k}}) AS m FROM kept AS x, c{r} AS c GROUP BY x.vec_id, x.v)""")
        if r < ROUNDS:
            parts.append(f"""u{r} AS (SELECT m.k AS k, i, CAST(sum(e) AS HUGEINT) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS e, unnest(range({DIM})) AS i FROM a{r}) GROUP BY m.k, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(f.v, c.v) AS v FROM c{r} AS c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM u{r} GROUP BY k) AS f USING (k))""")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(a.m.k AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON c.k = a.m.k"""
    )


OP12_SQL = _sql()
