"""Jaccard self-join on word n-grams by vertical partitioning, and the groups of documents that its links connect.

The n-grams of the corpus have one global order, cut into fragments. Each document's set is cut the same way; overlaps are counted fragment by fragment
and summed per pair. Only pairs that can reach the threshold are counted:

1. Documents with equal sets are one class. An n-gram's place in the first order is its hash. Two linked sets share at least l of their first
   (n - ceil(t n)) + l n-grams, so a class stays only if enough of that prefix is found in another class's prefix. Most texts end here.
2. Of the remaining classes, n-grams are ordered by document frequency, rarest first; a class whose unshared n-grams alone exceed n - ceil(t n) goes.
3. Candidates share an n-gram of the prefixes in that order. An n-gram's holders are not all paired with one another: each is paired with the smallest
   holder of fitting size, and the links found join groups; then with the nearest in size of another group. Links inside a group need no count, since
   they can't change the groups.
4. What these ``STARS`` leave undecided, classes in different groups that share a prefix n-gram, is gathered into clusters by chains along the n-gram's holders.
   A cluster is cut into blocks of at most about ``BLOCK`` classes; a task counts the overlaps between two blocks at once, stretch by stretch of the order, and
   hands back the links that join groups: at most one fewer than there are groups.

All tables are spread by fragment, class or pair; nothing about the documents comes to the driver but counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import BLOCK as BLOCK_OF_TEXT
from .bytetext import SPACED, hashed_words, mix, pieces
from .common import blob, by_slice, dropped, slices, text_buffer, written
from .components import contract

N = 5
#: Linked if DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: One more prefix n-gram, and a match more to be found, for every so many n-grams.
MORE = 12
FRAGMENT_BYTES = 24 << 20
FRAGMENTS = (64, 1 << 16)
#: Postings that a task gathers before it deals them out to fragments.
CHUNK = 1 << 20
#: Of the bitmap that tells the classes with company: 32 MB.
MOST_BITS = 1 << 28
#: Parts in which the overlap of a pair is counted.
SEGMENTS = 4
STARS = ("smallest", "nearest")
BLOCK = 512
#: N-grams whose holders are multiplied at once within a block.
STRETCH = 1024

_C = np.random.default_rng(20240313).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = N) -> list[np.ndarray]:
    """Each document's distinct n-gram hashes, ascending; fewer words than n are one n-gram, no word none."""
    if len(at) == 2 and len(data) > 8 * BLOCK_OF_TEXT:
        return [_long_set(data, n)]
    h, before = hashed_words(data, at, SPACED)
    count = np.diff(before)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        grams += h[j : len(h) - n + 1 + j] * _C[j]
    grams = mix(grams)
    out = []
    for k, c in enumerate(count.tolist()):
        b = int(before[k])
        if c >= n:
            out.append(np.unique(grams[b : b + c - n + 1]))
        elif c:
            out.append(mix((h[b : b + c] * _C[n : n + c]).sum(keepdims=True) + _C[62:63] * np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _long_set(data: np.ndarray, n: int) -> np.ndarray:
    """The same of one long text, piece by piece; the last words of a piece go on into the next one."""
    tail, found = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for a, b in pieces(data, SPACED):
        h = np.concatenate([tail, hashed_words(data[a:b], np.array([0, b - a]), SPACED)[0]])
        if len(h) >= n:
            grams = np.zeros(len(h) - n + 1, np.uint64)
            for j in range(n):
                grams += h[j : len(h) - n + 1 + j] * _C[j]
            found = np.union1d(found, mix(grams))
        tail = h[-(n - 1) :] if n > 1 else h[:0]
    # Fewer than n words in all: they are what is carried over.
    return found if len(found) or not len(tail) else mix((tail * _C[n : n + len(tail)]).sum(keepdims=True) + _C[62:63] * np.uint64(len(tail)))


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(t n): what a set of size n has in common with any linked one, at least."""
    return -(-NUM * n // DEN)


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    """By the leading bits: contiguous stretches of the order of the hashes. fragments: a power of two."""
    return (h >> np.uint64(65 - fragments.bit_length())).astype(np.int32)


def _spread(fragment: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each fragment, with the columns' values as binary; each document's values stay together, so they compress well."""
    order = np.argsort(fragment, kind="stable")
    f = fragment[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(f)) + 1, [len(f)]])
    blobs = [[blob(c[order[a:b]]) for a, b in zip(edges, edges[1:], strict=False)] for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(f[edges[:-1]], pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], ["f", *names])


def _gathered(table: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in kinds.items()]


def _fragments(postings: int, width: int) -> int:
    need = max(FRAGMENTS[0], -(-postings * width // FRAGMENT_BYTES))
    return min(FRAGMENTS[1], 1 << (need - 1).bit_length())


def _classes(docs: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, key): equal keys are equal sets."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def work(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        sets = shingle_sets(data, at, n)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "key"])

    return written(rows.mapInArrow(by_slice(work, "text"), f"doc_id {kind}, n_shingles long, key long"), "classes")


def _in_chunks(batches: Iterator[pa.RecordBatch], n: int, cut, names: list[str]) -> Iterator[pa.RecordBatch]:
    """For texts in the last column: ``cut`` gives the fragments and columns of a document's postings, or None; dealt out a chunk at a time, equal sets once."""
    held, size, seen = [], 0, set()

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            fragment, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from _spread(fragment, columns, names)

    for batch in batches:
        raw, at = text_buffer(batch.column(batch.num_columns - 1))
        for a, b in slices(at):
            for i, s in enumerate(shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], n)):
                if len(s) and (key := set_key(s)) not in seen and (part := cut(batch, a + i, key, s)) is not None:
                    seen.add(key)
                    held.append(part)
                    size += len(part[0])
            if size >= CHUNK:
                yield from out()
                held, size, seen = [], 0, set()
    yield from out()


def _with_company(docs: DataFrame, classes: DataFrame, text: str, n: int) -> DataFrame:
    """(key, n_shingles) of the classes with enough of their prefix in others' prefixes."""
    sizes = classes.where("key is not null").groupBy("key").agg(F.first("n_shingles").alias("n_shingles"))
    total = classes.agg(F.sum(F.col("n_shingles") / 3 + 1)).first()[0] or 0
    fragments = _fragments(int(total), 12)

    def prefix(_batch: pa.RecordBatch, _row: int, key: int, s: np.ndarray) -> tuple:
        m = len(s)
        first = s[: m - int(least_overlap(m)) + 1 + m // MORE]
        # Low hashes only are dealt out here, so another mix of their bits spreads them evenly.
        other = mix(first)
        return _fragment(other, fragments), other.astype(np.uint32), np.full(len(first), key, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_chunks(batches, n, prefix, ["h", "k"])

    def shared(table: pa.Table) -> pa.Table:
        h, k = _gathered(table, {"h": np.uint32, "k": np.int64})
        order = np.argsort(h)
        h, k = h[order], k[order]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        h, k = h[twin], k[twin]
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k = h[fresh], k[fresh]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        keys, count = np.unique(k[twin], return_counts=True)
        return pa.table({"key": pa.array(keys, pa.int64()), "found": pa.array(count, pa.int64())})

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(deal, "f int, h binary, k binary").groupBy("f").applyInArrow(shared, "key long, found long")
    enough = found.groupBy("key").agg(F.sum("found").alias("found"))
    return written(sizes.join(enough, "key").where(F.col("found") >= 1 + F.floor(F.floor(F.col("n_shingles") * 3 / 4) / MORE)).drop("found"), "with_company")


def _bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """A bit for each hash of a key, as bytes: at most ``MOST_BITS``, however many keys there are. Made on the executors in pieces."""
    bits = min(MOST_BITS, 1 << max(18, (16 * count).bit_length()))
    piece = 1 << 15

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            at = _bit(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(flags, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = flags.reshape(-1, piece)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["p", "flags"])

    def join(table: pa.Table) -> pa.Table:
        flags = np.zeros(piece, np.uint8)
        for x in table.column("flags").to_pylist():
            flags |= np.frombuffer(x, np.uint8)
        return pa.table({"p": table.column("p").slice(0, 1), "flags": pa.array([flags.tobytes()], pa.binary())})

    out = np.zeros(bits >> 3, np.uint8)
    for r in keys.select("key").mapInArrow(mark, "p int, flags binary").groupBy("p").applyInArrow(join, "p int, flags binary").collect():
        out[r[0] * piece : (r[0] + 1) * piece] = np.frombuffer(bytes(r[1]), np.uint8)
    return out


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _shared_sets(docs: DataFrame, kept: DataFrame, text: str, n: int) -> DataFrame:
    """(key, n, shared, prefix) of the classes that can still be linked: their n-grams held by several classes, and the rarest of these that any link must meet.

    Texts are cut into n-grams again; a bitmap of the classes tells which to go on with. Where it takes in a few classes more, nothing changes in the result.
    """
    size = kept.agg(F.sum("n_shingles"), F.count("*")).first()
    fragments, buckets = _fragments(size[0] or 0, 20), min(FRAGMENTS[1], max(FRAGMENTS[0], (size[1] or 0) // 2000))
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    flags = _bitmap(kept, size[1])
    shipped = docs.sparkSession.sparkContext.broadcast(flags)

    def whole(_batch: pa.RecordBatch, _row: int, key: int, s: np.ndarray) -> tuple | None:
        known = shipped.value
        at = int(_bit(np.array([key]), len(known) * 8)[0])
        if not known[at >> 3] >> (at & 7) & 1:
            return None
        return _fragment(s, fragments), s, np.full(len(s), key, np.int64), np.full(len(s), len(s), np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_chunks(batches, n, whole, ["h", "k", "n"])

    def frequent(table: pa.Table) -> pa.Table:
        h, k, m = _gathered(table, {"h": np.uint64, "k": np.int64, "n": np.int32})
        order = np.lexsort((k, h))
        h, k, m = h[order], k[order], m[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k, m = h[fresh], k[fresh], m[fresh]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        run = np.cumsum(first) - 1
        df = np.bincount(run)[run] if len(h) else np.zeros(0, np.int64)
        many = df > 1
        bucket = (mix(k[many].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        out = list(_spread(bucket, [h[many], k[many], m[many], df[many].astype(np.int32)], ["h", "k", "n", "df"])) if many.any() else []
        return pa.Table.from_batches(out, schema=pa.schema([("f", pa.int32()), *[(c, pa.binary()) for c in ("h", "k", "n", "df")]]))

    def prefixes(table: pa.Table) -> pa.Table:
        h, k, m, df = _gathered(table, {"h": np.uint64, "k": np.int64, "n": np.int32, "df": np.int32})
        order = np.lexsort((h, df, k))
        h, k, m, df = h[order], k[order], m[order], df[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]]) if len(k) else np.zeros(1, np.int64)
        out: list[tuple] = []
        for a, b in zip(edges, edges[1:], strict=False):
            size = int(m[a])
            need = size - int(least_overlap(size)) + 1 - (size - (b - a))
            if need > 0:
                out.append((int(k[a]), size, blob(np.sort(h[a:b])), blob(h[a : a + need])))
        names = [("key", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("prefix", pa.binary())]
        return pa.table([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True) if out else [[]] * 4, names, strict=True)], names=[c for c, _ in names])

    postings = rows.mapInArrow(deal, "f int, h binary, k binary, n binary")
    shared = postings.groupBy("f").applyInArrow(frequent, "f int, h binary, k binary, n binary, df binary")
    return written(shared.groupBy("f").applyInArrow(prefixes, "key long, n long, shared binary, prefix binary"), "shared_sets")


def _candidates(sets: DataFrame, labels: DataFrame | None, star: str, fragments: int) -> DataFrame:
    """Distinct (a, b): classes that share an n-gram of their prefixes and whose sizes fit, of n-grams held in several groups; each holder with one other ("chain": the next smaller one) at most."""
    rows = sets.select("key", "n", "prefix", F.col("key").alias("group")) if labels is None else sets.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "prefix", F.coalesce("root", "key").alias("group"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                h, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from _spread(_fragment(h, fragments), [h, *columns], ["h", "k", "n", "g"])

        for batch in batches:
            for key, n, prefix, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(prefix, np.uint64)
                held.append((h, np.full(len(h), key, np.int64), np.full(len(h), n, np.int32), np.full(len(h), group, np.int64)))
                size += len(h)
            if size >= CHUNK:
                yield from out()
                held, size = [], 0
        yield from out()

    def pair(table: pa.Table) -> pa.Table:
        h, k, n, g = _gathered(table, {"h": np.uint64, "k": np.int64, "n": np.int32, "g": np.int64})
        order = np.lexsort((k, n, h))
        h, k, n, g = h[order], k[order], n[order].astype(np.int64), g[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        lists = np.cumsum(first) - 1
        # A list all in one group has nothing to decide.
        begin = np.flatnonzero(first)
        mixed = np.maximum.reduceat((g != g[begin][lists]).astype(np.int8), begin) > 0 if len(h) else np.zeros(0, bool)
        keep = mixed[lists] if len(h) else mixed
        k, n, g, lists = k[keep], n[keep], g[keep], lists[keep]
        place = (lists << 32) + n
        low = np.searchsorted(place, (lists << 32) + least_overlap(n))
        own = np.arange(len(k))
        changed = np.ones(len(k), bool)
        changed[1:] = (lists[1:] != lists[:-1]) | (g[1:] != g[:-1])
        starts = np.flatnonzero(changed)
        if star == "smallest":  # or, where that is of the same group, the first of another one
            after = np.append(starts, len(k))[np.searchsorted(starts, low, side="right")]
            to = np.where(g[low] != g, low, after)
        elif star == "nearest":  # of another group among those no larger
            to = starts[np.searchsorted(starts, own, side="right") - 1] - 1
        else:
            to = own - 1
        good = (to >= low) & (to < own)
        return _pairs(k[to[good]], k[own[good]])

    found = rows.mapInArrow(deal, "f int, h binary, k binary, n binary, g binary").groupBy("f").applyInArrow(pair, "a long, b long")
    return found.distinct()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return pa.table({"a": pa.array(low[fresh], pa.int64()), "b": pa.array(high[fresh], pa.int64())})


def _linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs whose overlap, counted by segment and summed, reaches the threshold: (a, b, overlap, n_a, n_b)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(u) and len(v):
                    out[i] = np.count_nonzero(u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], ["a", "b", "n_a", "n_b", "overlap"])

    of_b = segments.select(F.col("key").alias("b"), "s", F.col("n").alias("n_b"), F.col("part").alias("y"))
    of_a = segments.select(F.col("key").alias("a"), "s", F.col("n").alias("n_a"), F.col("part").alias("x"))
    both = pairs.join(of_b, "b").join(of_a, ["a", "s"]).select("a", "b", "n_a", "n_b", "x", "y")
    sums = both.mapInArrow(count, "a long, b long, n_a long, n_b long, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return sums.where(F.col("overlap") * DEN >= NUM * (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def _segments(sets: DataFrame) -> DataFrame:
    """(key, s, n, part): each class's shared n-grams, cut at the same places of the order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(shared, np.uint64)
                at = np.searchsorted(_fragment(h, SEGMENTS), np.arange(SEGMENTS + 1))
                parts = [(s, blob(h[at[s] : at[s + 1]])) for s in range(SEGMENTS)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), pa.int64()), pa.array([s for s, _ in parts], pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p for _, p in parts], pa.binary())], ["key", "s", "n", "part"])

    return written(sets.select("key", "n", "shared").mapInArrow(cut, "key long, s int, n long, part binary"), "segments")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``a`` has in common with each of ``b``: the order is cut into stretches, and the stretches' counts are summed."""
    out = np.zeros((len(a), len(b)), np.float32)
    x, y = np.concatenate(a), np.concatenate(b)
    row_x, row_y = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    both = np.intersect1d(x, y)
    for i in range(0, len(both), STRETCH):
        part = both[i : i + STRETCH]
        sides = []
        for h, row, n in ((x, row_x, len(a)), (y, row_y, len(b))):
            at = np.minimum(np.searchsorted(part, h), len(part) - 1)
            hit = part[at] == h
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _undecided(sets: DataFrame, chains: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The links (a, b, overlap, n_a, n_b) that join groups within the clusters of ``chains``."""
    clusters = contract(chains, "clusters").withColumnRenamed("node", "key").withColumnRenamed("root", "cluster")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = sets.select("key", "n", "shared").join(clusters, "key")
    rows = rows.withColumn("g", F.col("key")) if labels is None else rows.join(labels.select(F.col("node").alias("key"), F.col("root").alias("_r")), "key", "left").withColumn("g", F.coalesce("_r", "key")).drop("_r")
    rows = rows.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "g", "shared")

    def solve(table: pa.Table) -> pa.Table:
        block, key, n, g = (table.column(c).to_numpy() for c in ("block", "key", "n", "g"))
        shared = [np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()]
        i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        out: list[tuple] = []
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(a) and len(b) and len(np.unique(g)) > 1:
            common = _overlaps([shared[k] for k in a], [shared[k] for k in b])
            linked = (common * DEN >= NUM * (n[a][:, None] + n[b][None, :] - common)) & (g[a][:, None] != g[b][None, :])
            x, y = np.nonzero(linked)
            groups = np.stack([np.minimum(g[a[x]], g[b[y]]), np.maximum(g[a[x]], g[b[y]])], axis=1)
            _, first = np.unique(groups, axis=0, return_index=True)
            roots: dict[int, int] = {}

            def root(v: int) -> int:
                while roots.get(v, v) != v:
                    v = roots[v]
                return v

            for k in first.tolist():
                p, q = root(int(g[a[x[k]]])), root(int(g[b[y[k]]]))
                if p != q:
                    roots[max(p, q)] = min(p, q)
                    out.append((int(key[a[x[k]]]), int(key[b[y[k]]]), int(common[x[k], y[k]]), int(n[a[x[k]]]), int(n[b[y[k]]])))
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["a", "b", "overlap", "n_a", "n_b"])

    return rows.groupBy("cluster", "i", "j").applyInArrow(solve, "a long, b long, overlap long, n_a long, n_b long")


def link_classes(docs: DataFrame, classes: DataFrame, text: str = "text", n: int = N) -> tuple[DataFrame, DataFrame]:
    """The links counted between classes (a, b, overlap, n_a, n_b), enough to connect each group, and the groups (node, root)."""
    spark = docs.sparkSession
    kept = _with_company(docs, classes, text, n)
    sets = _shared_sets(docs, kept, text, n)
    dropped(kept)
    segments = _segments(sets)
    total = sets.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    fragments = _fragments(int(total), 28)
    links, labels = None, None
    for star in (*STARS, "chain"):
        pairs = written(_candidates(sets, labels, star, fragments), f"pairs_{star}")
        if pairs.isEmpty():
            dropped(pairs)
            continue
        found = written(_linked(pairs, segments) if star in STARS else _undecided(sets, pairs, labels), f"links_{star}")
        dropped(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = contract(links, f"groups_{star}")
    dropped(sets, segments)
    if links is None:
        links = spark.createDataFrame([], "a long, b long, overlap long, n_a long, n_b long")
    return links, labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N) -> DataFrame:
    """A row for each document: doc_id, n_shingles (size of its set), component_id (the least id that links reach), copies (documents with an equal set).

    Defined cases: a null text, or one without words, has an empty set and is its own component; fewer than n words are one n-gram; repeated rows are
    copies of one another; a null id takes part, and is a component_id only where no other id is reached; other columns of ``docs`` are ignored.
    """
    classes = _classes(docs, text, doc_id, n)
    _, labels = link_classes(docs, classes, text, n)
    per_class = classes.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    grouped = per_class.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    grouped = written(grouped, "grouped")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = written(grouped.join(least, "root").select("key", "component_id", "copies"), "components")
    dropped(grouped)
    out = classes.join(of_key, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``: Jaccard of five-word shingles of at least 0.75."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
