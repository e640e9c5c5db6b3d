"""Training-order materialisation: every token sequence gets a global slot by a keyed permutation, and shards hold their slots in order at a fixed stride.

A sequence's number is a 64-bit hash of its text, its place among the columns kept and its place in the document, scaled to a range [0, M); a Feistel network
over the next even number of bits, walked along its cycles until it falls inside the range, permutes the numbers. M is the bytes of all texts plus one for each document: no
smaller than the number of sequences, and known without a token. Range partitions over the permuted numbers are the shards; equal numbers go by the hash. A sequence's slot is
its place in that order, so it depends on the rows and the key alone, not on files, partitions or the number of shards; another key gives another epoch.

Tokens are shuffled once. Each range partition streams its sequences into one file of a fixed stride: slot s of a shard that begins at slot f is at byte
(s - f) * stride, so a reader goes through a shard sequentially and resumes anywhere. Files are written beside their place and moved to it when whole, so
a task that is run again leaves the same file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import mix
from .common import run_folder, slices, text_buffer, written
from .tokens import Encoder, tokenizer_path

SEQUENCE = 512
END = 50256
KEY = 0x5EED
ROUNDS = 6
#: Bytes of text whose sequences make a shard: about 64 MB of tokens.
SHARD_BYTES = 32 << 20
ADDED = ("seq", "n_tokens", "slot", "shard", "byte")


def _round_keys(key: int) -> np.ndarray:
    return np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)


def _feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left, right = right, left ^ ((f >> np.uint64(32)) & mask)
    return (left << np.uint64(half)) | right


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each number below n: a permutation of them."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    keys = _round_keys(key)
    out = _feistel(index.astype(np.uint64), half, keys)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _feistel(out[outside], half, keys)
    return out.astype(np.int64)


def scaled(h: np.ndarray, n: int) -> np.ndarray:
    """floor(h n / 2**64) for 64-bit hashes, in halves so that nothing overflows; n below 2**62."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    n_low, n_high = np.uint64(n & 0xFFFFFFFF), np.uint64(n >> 32)
    cross = high * n_low + ((low * n_low) >> np.uint64(32))
    middle = low * n_high + (cross & np.uint64(0xFFFFFFFF))
    return high * n_high + (cross >> np.uint64(32)) + (middle >> np.uint64(32))


def id_bytes(tokenizer: str) -> int:
    """2 if all ids of the tokenizer's file are below 65536, else 4."""
    with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
        content = json.load(f)
    ids = [*content["model"]["vocab"].values(), *(t["id"] for t in content.get("added_tokens", []))]
    return 2 if max(ids, default=0) < 1 << 16 else 4


def tokenise(docs: DataFrame, cols: list[str], text: str, tokenizer: str, length: int, end: int, n: int, key: int, width: int) -> DataFrame:
    """A row for each sequence: ``cols``, seq (its number in the document), n_tokens, _place (its permuted number), _tie (its hash), _tokens (little-endian, of ``width`` bytes each, not filled up)."""
    # A row's own hash tells apart equal texts of different documents.
    own = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in cols], F.lit(len(cols)), F.col(f"`{text}`"))
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], own.alias("_own"), F.col(f"`{text}`").alias("_text"))
    schema = rows.select(*cols, F.lit(0).alias("seq"), F.lit(0).alias("n_tokens"), F.lit(0).cast("long").alias("_place"), F.lit(0).cast("long").alias("_tie"), F.lit(b"").alias("_tokens")).schema
    most = (1 << 8 * width) - 1
    if not 0 <= end <= most:
        raise ValueError(f"the end token {end} does not fit into {width} bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path(tokenizer))
        for batch in batches:
            raw, at = text_buffer(batch.column(batch.num_columns - 1))
            for a, b in slices(at):
                part = batch.slice(a, b - a)
                ids, begins = encoder.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                if len(ids) and int(ids.max()) > most:
                    raise ValueError(f"id {int(ids.max())} does not fit into {width} bytes")
                size = np.diff(begins) + 1
                count = -(-size // length)
                row = np.repeat(np.arange(b - a), count)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                n_tokens = np.minimum(length, size[row] - seq * length)
                # Each document's ids, with the end token after them.
                whole = np.full(len(ids) + b - a, end, f"<u{width}")
                whole[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(begins))] = ids
                edges = np.concatenate([[0], np.cumsum(n_tokens)]) * width
                tokens = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(whole)])
                own = part.column(len(cols)).to_numpy().view(np.uint64)[row]
                tie = mix(own + seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                place = permute(scaled(tie, n), n, key)
                kept = part.select(list(range(len(cols)))).take(pa.array(row)).columns if cols else []
                yield pa.RecordBatch.from_arrays([*kept, pa.array(seq, pa.int32()), pa.array(n_tokens, pa.int32()), pa.array(place), pa.array(tie.view(np.int64)), tokens], schema.names)

    return rows.mapInArrow(work, schema)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def shard_file(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.bin"


def write_shards(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, tokenizer: str = "byte_bpe_50k.json", length: int = SEQUENCE, end: int = END, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards' files to the folder ``path`` and returns where each sequence is: ``keep`` columns (all but the text if None), seq, n_tokens, slot, shard, byte.

    Defined cases: a null or empty text is one sequence of the end token; an empty table has no sequence and no file; repeated rows have slots of their own, side by
    side; columns of ``docs`` named like an added one are replaced. Slots depend on the kept columns, the texts and the key alone. An id beyond the files' integers (two bytes, or
    four where the vocabulary needs them) raises. ``path`` is one that pyarrow's file systems know (local, hdfs, s3, gs, abfs).
    """
    cols = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in ADDED]
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1)).first()[0] or 0
    n, shards, width = max(1, size), max(1, -(-size // shard_bytes)), id_bytes(tokenizer)
    found = tokenise(docs, cols, text, tokenizer, length, end, n, key, width)
    target = F.floor(F.col("_place") / F.lit(n) * shards).cast("int")
    ordered = found.withColumn("shard", F.least(target, F.lit(shards - 1))).repartitionById(shards, F.col("shard")).sortWithinPartitions("_place", "_tie")
    ordered = ordered.select(*cols, "seq", "n_tokens", "shard", "_tokens")
    schema = ordered.drop("_tokens").withColumn("_at", F.lit(0).cast("long")).schema
    stride, filler = length * width, np.array([end], f"<u{width}").tobytes()
    folder, place = _open(path)
    folder.create_dir(place, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name, own = None, 0, "", ""
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                files, here = _open(path)
                name = shard_file(here, b.column(len(schema.names) - 2)[0].as_py())
                own = f"{name}.{uuid.uuid4().hex}"
                out = files.open_output_stream(own)
            tokens = b.column(b.num_columns - 1)
            edges = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
            data = np.frombuffer(tokens.buffers()[2], np.uint8)
            for i in range(0, len(tokens), 1024):
                e = edges[i : min(i + 1024, len(tokens)) + 1]
                rows = np.frombuffer(filler * (length * (len(e) - 1)), np.uint8).copy()
                each = np.diff(e)
                rows[np.arange(e[-1] - e[0]) + np.repeat(np.arange(len(each)) * stride - (e[:-1] - e[0]), each)] = data[e[0] : e[-1]]
                out.write(rows.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.arange(at, at + b.num_rows))], schema.names)
            at += b.num_rows
        if out is not None:
            out.close()
            files.move(own, name)

    places = written(ordered.mapInArrow(write, schema), "places")
    # A row for each shard: how many slots lie before it.
    counts = places.groupBy("shard").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("shard", before.alias("_first"))
    out = places.join(first, "shard")
    return out.select(*cols, "seq", "n_tokens", (F.col("_first") + F.col("_at")).alias("slot"), "shard", (F.col("_at") * stride).alias("byte"))


def read_shard(path: str, shard: int, stride: int, byte: int = 0) -> Iterator[bytes]:
    """The sequences of a shard in order from a byte on: where a reader goes on."""
    files, place = _open(path)
    with files.open_input_file(shard_file(place, shard)) as f:
        f.seek(byte)
        while block := f.read(stride):
            yield block


def with_digests(places: DataFrame, path: str, stride: int) -> DataFrame:
    """``places`` with tokens_crc32 of what lies at each place in the files. Rows that come in the files' order are read in one go."""
    names = places.columns
    schema = places.withColumn("tokens_crc32", F.lit(0).cast("long")).schema

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, here = _open(path)
        for b in batches:
            shard, byte = b.column(names.index("shard")).to_numpy(), b.column(names.index("byte")).to_numpy()
            out = np.zeros(len(shard), np.int64)
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (byte[1:] != byte[:-1] + stride)) + 1
            for rows in np.split(np.arange(len(shard)), cut):
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    with files.open_input_file(shard_file(here, int(shard[part[0]]))) as f:
                        data = memoryview(f.read_at(len(part) * stride, int(byte[part[0]])))
                    out[part] = [crc32(data[i * stride : (i + 1) * stride]) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], schema.names)

    return places.mapInArrow(digest, schema)


def op6_training_order(spark, sf_dir: str) -> DataFrame:
    """Writes the shards of ``documents`` to a run folder under the shared one; slot, shard and place of every token sequence, with a digest of the tokens read back from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = run_folder(spark, "shards")
    places = write_shards(docs, path, keep=["doc_id"])
    return with_digests(places, path, SEQUENCE * id_bytes("byte_bpe_50k.json")).select("doc_id", "seq", "n_tokens", "slot", "shard", "byte", "tokens_crc32")
