"""TIFF and BigTIFF stacks as voxels: pages of one size, one channel, unsigned 16-bit or 32-bit float, in strips or tiles, plain or compressed (LZW, Deflate, PackBits, with predictors).

``Scan.open`` walks the page directories once, reading a few bytes a page. ``Scan.voxels`` is a Spark data source over what it found: every partition reads the byte ranges of some
strips or tiles, so one file of any size is read by many tasks, each of which holds one strip or tile at a time; pages that are not asked for are not read. Files are
opened through pyarrow's file systems (local, hdfs, s3, gs). ``read_stacks`` is for stores that only Spark reads: it goes through Spark's binary source, a whole file of up to 2 GB in a task.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tags of the format, bytes of its types, and its compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773
#: Pixels' bytes that a partition reads, and voxels in a batch.
PART_BYTES, BATCH = 16 << 20, 1 << 18
SCHEMA = "n int, row int, col int, u double"


class Directory:
    """The pages of an open file (anything with ``read_at(bytes, offset)``, as pyarrow's files)."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        head = file.read_at(min(16, self.size), 0)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or len(head) < 8:
            raise ValueError("not a TIFF file")
        version = struct.unpack(self.order + "H", head[2:4])[0]
        self.big = version == 43
        if version not in (42, 43) or (self.big and len(head) < 16):
            raise ValueError("not a TIFF file")
        # Of a directory's count, an entry, and an offset.
        self.codes = ("Q", "HHQ8s", "Q") if self.big else ("H", "HHI4s", "I")
        self.first = self.numbers(self.codes[2], head[8:16] if self.big else head[4:8])[0]

    def numbers(self, code: str, raw: bytes) -> tuple:
        return struct.unpack(self.order + code, raw)

    def bytes_at(self, at: int, size: int) -> bytes:
        if at + size > self.size:
            raise ValueError("the TIFF file ends too early")
        return self.file.read_at(size, at)

    def entries(self, at: int) -> tuple[dict[int, tuple], int]:
        """tag -> (type, count, raw) of the directory at a place, and where the next one is."""
        code, entry, offset = (struct.calcsize("<" + c) for c in self.codes)
        count = self.numbers(self.codes[0], self.bytes_at(at, code))[0]
        raw = self.bytes_at(at + code, count * entry + offset)
        found = {}
        for k in range(count):
            tag, kind, many, value = self.numbers(self.codes[1], raw[k * entry : (k + 1) * entry])
            found[tag] = (kind, many, value)
        return found, self.numbers(self.codes[2], raw[count * entry :])[0]

    def values(self, entry: tuple) -> tuple[int, ...]:
        kind, many, raw = entry
        code, size = SIZES[kind]
        if many * size > len(raw):
            raw = self.bytes_at(self.numbers(self.codes[2], raw)[0], many * size)
        return self.numbers(f"{many}{code}", raw[: many * size])

    def places(self) -> Iterator[int]:
        """Where the pages' directories are."""
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise ValueError("the TIFF file's directories go round in a circle")
            seen.add(at)
            yield at
            at = self.entries(at)[1]

    def page(self, at: int) -> Page:
        tags, _ = self.entries(at)

        def one(tag: int, default: int) -> int:
            return self.values(tags[tag])[0] if tag in tags and tags[tag][0] in SIZES else default

        bits, form = one(BITS, 1), one(FORMAT, 1)
        if one(SAMPLES, 1) != 1 or (bits, form) not in ((16, 1), (32, 3)):
            raise ValueError(f"pages must be one channel of 16-bit unsigned or 32-bit float; this one has {bits} bits of format {form}")
        way, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if way not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS) or predictor not in (1, 2, 3) or (predictor == 3 and form != 3):
            raise ValueError(f"compression {way} with predictor {predictor} is not read")
        width, height = one(WIDTH, 0), one(HEIGHT, 0)
        tiled = TILE_OFFSETS in tags
        if not width or not height or (TILE_OFFSETS if tiled else OFFSETS) not in tags:
            raise ValueError("a page without a size or a place")
        across, down = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(height, one(ROWS, height)))
        return Page(self, width, height, "u2" if bits == 16 else "f4", way, predictor, across, down, tiled, tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS])


@dataclass
class Page:
    """One page and its pieces (strips or tiles), numbered row by row."""

    directory: Directory
    width: int
    height: int
    kind: str
    way: int
    predictor: int
    across: int
    down: int
    tiled: bool
    offsets: tuple
    counts: tuple

    @property
    def pieces(self) -> int:
        return -(-self.width // self.across) * -(-self.height // self.down)

    def piece(self, k: int, offsets: tuple[int, ...], counts: tuple[int, ...]) -> tuple[int, int, np.ndarray]:
        """First row and column of a piece, and its pixels within the page."""
        row, col = k // -(-self.width // self.across) * self.down, k % -(-self.width // self.across) * self.across
        rows = self.down if self.tiled else min(self.down, self.height - row)
        raw = expanded(self.directory.bytes_at(offsets[k], counts[k]), self.way)
        item = 2 if self.kind == "u2" else 4
        if len(raw) < rows * self.across * item:
            raise ValueError("a strip or tile of the TIFF file is too short")
        pixels = unpredicted(raw[: rows * self.across * item], rows, self.across, self.directory.order + self.kind, self.predictor)
        return row, col, pixels[: self.height - row, : self.width - col]

    def parts(self, first: int = 0, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        offsets, counts = self.directory.values(self.offsets), self.directory.values(self.counts)
        for k in range(first, self.pieces if end is None else end):
            yield self.piece(k, offsets, counts)

    def whole(self) -> np.ndarray:
        out = np.zeros((self.height, self.width), self.kind)
        for row, col, pixels in self.parts():
            out[row : row + pixels.shape[0], col : col + pixels.shape[1]] = pixels
        return out


def expanded(raw: bytes, way: int) -> bytes:
    if way == PLAIN:
        return raw
    if way in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    return _packed_bits(raw) if way == PACK_BITS else _lzw(raw)


def _packed_bits(raw: bytes) -> bytes:
    """Runs: a count below 128 copies count + 1 bytes, one above repeats the next byte 257 - count times."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, one wider a code before the table needs it; 256 clears the table, 257 ends."""
    known, out, last = [bytes([k]) for k in range(256)] + [b"", b""], [], b""
    held, bits, width = 0, 0, 9
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del known[258:]
            width, last = 9, b""
            continue
        if code > len(known) or (code == len(known) and not last):
            raise ValueError("a broken LZW code")
        text = known[code] if code < len(known) else last + last[:1]
        out.append(text)
        if last:
            known.append(last + text[:1])
            width = min(12, (len(known) + 1).bit_length())
        last = text
    return b"".join(out)


def unpredicted(raw: bytes, rows: int, width: int, kind: str, predictor: int) -> np.ndarray:
    """Pixels of a piece: as they are, from differences along a row, or from differences of the bytes of a row's floats, sorted by significance."""
    if predictor == 1:
        return np.frombuffer(raw, kind).reshape(rows, width)
    if predictor == 2:
        whole = np.frombuffer(raw, kind[0] + "u" + kind[2:]).reshape(rows, width)
        return np.cumsum(whole, axis=1, dtype=whole.dtype.newbyteorder("=")).view(kind[1:])
    bytes_ = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, 4, width)
    return np.ascontiguousarray(bytes_.transpose(0, 2, 1)).view(">f4").reshape(rows, width)


def opened(path: str):
    """A file to read at places: of this machine, or of a store that pyarrow knows."""
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    files, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(place)


def walked(path: str) -> list[tuple[int, int, int, str, int, int]]:
    """(place, height, width, kind, pieces, rows and columns' bytes of a piece) of the pages of a file."""
    with opened(path) as file:
        directory = Directory(file)
        out = []
        for at in directory.places():
            p = directory.page(at)
            out.append((at, p.height, p.width, p.kind, p.pieces, p.across * p.down * (2 if p.kind == "u2" else 4)))
        return out


@dataclass
class Range(InputPartition):
    """Pieces first to end of some pages of one file: (n, place of the directory, first, end)."""

    path: str
    runs: list[tuple[int, int, int, int]]

    def __post_init__(self):
        super().__init__(None)


class TiffReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["directory"]) if options.get("directory") else [[options["path"], walked(options["path"])]]
        self.first, self.count = int(options.get("first", 0)), int(options.get("count", -1))
        self.most = int(options.get("bytesperpartition", options.get("bytesPerPartition", PART_BYTES)))

    def partitions(self) -> list[InputPartition]:
        """Neighbouring pieces of a file up to the bytes of a partition; a page may be parted."""
        out, n, end = [], -1, self.first + self.count if self.count >= 0 else None
        for path, pages in self.files:
            runs, size = [], 0
            for at, _, _, _, pieces, bytes_ in pages:
                n += 1
                if n < self.first or (end is not None and n >= end):
                    continue
                k = 0
                while k < pieces:
                    step = min(pieces - k, max(1, (self.most - size) // max(1, bytes_)))
                    runs.append((n - self.first, at, k, k + step))
                    k, size = k + step, size + step * bytes_
                    if size + bytes_ > self.most:
                        out.append(Range(path, runs))
                        runs, size = [], 0
            if runs:
                out.append(Range(path, runs))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["n", "row", "col", "u"]
        with opened(partition.path) as file:
            directory = Directory(file)
            for n, at, first, end in partition.runs:
                for row, col, pixels in directory.page(at).parts(first, end):
                    step = max(1, BATCH // pixels.shape[1])
                    for a in range(0, len(pixels), step):
                        part = pixels[a : a + step]
                        h, w = part.shape
                        rows = np.repeat(np.arange(row + a, row + a + h, dtype=np.int32), w)
                        cols = np.tile(np.arange(col, col + w, dtype=np.int32), h)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, n, np.int32)), pa.array(rows), pa.array(cols), pa.array(part.astype(np.float64).ravel())], names)


class TiffSource(DataSource):
    """spark.read.format("tiff_pages").option("path", ...): the voxels of one file. Options: first and count of the pages, bytesPerPartition; ``directory``: several files, already walked."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


@dataclass
class Scan:
    """Files whose pages, in order of the files' names, are the images of one scan."""

    spark: SparkSession
    files: list[tuple[str, list[tuple]]]

    @classmethod
    def open(cls, spark: SparkSession, paths: str | list[str]) -> Scan:
        """Walks the directories of all files (Spark lists them: files, folders or patterns). Raises ValueError on a page that can't be read or differs from the first in size or kind."""
        listed = spark.read.format("binaryFile").load(paths).select("path")
        names = sorted(r.path for r in listed.collect())  # a row for each file; their content is not read
        if not names:
            raise ValueError(f"no file at {paths}")
        with ThreadPoolExecutor(16) as pool:
            files = list(zip(names, pool.map(walked, names), strict=True))
        kinds = {p[1:4] for _, pages in files for p in pages}
        if len(kinds) > 1:
            raise ValueError(f"pages differ in size or kind: {sorted(kinds)}")
        if not kinds:
            raise ValueError("the files have no page")
        return cls(spark, files)

    @property
    def images(self) -> int:
        return sum(len(pages) for _, pages in self.files)

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and columns of a page."""
        return next(p[1:3] for _, pages in self.files for p in pages)

    @property
    def kind(self) -> str:
        return next(p[3] for _, pages in self.files for p in pages)

    def voxels(self, first: int = 0, count: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
        """(n, row, col, u) of the pages from ``first`` on, n from 0."""
        self.spark.dataSource.register(TiffSource)
        directory = json.dumps([[path, pages] for path, pages in self.files])
        return self.spark.read.format("tiff_pages").options(directory=directory, first=first, count=-1 if count is None else count, bytesPerPartition=part_bytes).load()


def each_page(data: bytes) -> Iterator[np.ndarray]:
    """One page after the other of a file's bytes."""
    directory, shape = Directory(pa.BufferReader(data)), None
    for n, at in enumerate(directory.places()):
        page = directory.page(at).whole()
        if shape is not None and page.shape != shape:
            raise ValueError(f"page {n} has size {page.shape}, the first {shape}")
        shape = page.shape
        yield page


def pages(data: bytes) -> list[np.ndarray]:
    """All pages; raises ValueError on any other kind of file, or pages that differ in size."""
    return list(each_page(data))


def encode(stack: np.ndarray, big: bool = False, tile: tuple[int, int] | None = None, deflate: bool = False) -> bytes:
    """A little-endian file of (page, row, col) numbers of type u2 or f4: one strip a page, or tiles of (rows, columns); as BigTIFF; with Deflate and differences along the rows."""
    offset = "<Q" if big else "<I"
    body = bytearray((b"II+\0\x08\0\0\0" if big else b"II*\0") + struct.pack(offset, 0))
    link = len(body) - struct.calcsize(offset)
    form, bits = (3, 32) if stack.dtype.kind == "f" else (1, 16)
    differ = deflate and form == 1

    def place(data: bytes) -> int:
        body.extend(b"\0" * (len(body) % 2))
        body.extend(data)
        return len(body) - len(data)

    for page in stack:
        h, w = page.shape
        th, tw = tile or (h, w)
        wide = np.zeros((-(-h // th) * th, -(-w // tw) * tw), stack.dtype.newbyteorder("<"))
        wide[:h, :w] = page
        chunks = []
        for r in range(0, h, th):
            for c in range(0, w, tw):
                piece = wide[r : r + th, c : c + tw]
                if differ:
                    piece = np.diff(piece, axis=1, prepend=np.zeros((len(piece), 1), piece.dtype)).astype("<u2")
                data = np.ascontiguousarray(piece).tobytes()
                chunks.append(zlib.compress(data, 1) if deflate else data)
        at, size = [place(x) for x in chunks], [len(x) for x in chunks]
        where = (TILE_OFFSETS, TILE_COUNTS) if tile else (OFFSETS, COUNTS)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits]), (COMPRESSION, 3, [DEFLATE if deflate else PLAIN]), (SAMPLES, 3, [1]), (FORMAT, 3, [form]), (PREDICTOR, 3, [2 if differ else 1])]
        tags += [(where[0], 16 if big else 4, at), (where[1], 4, size), *([(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th])] if tile else [(ROWS, 4, [h])])]
        entries, room = [], 8 if big else 4
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{SIZES[kind][0]}", *values)
            if len(raw) > room:
                raw = struct.pack(offset, place(raw))
            entries.append(struct.pack("<HHQ" if big else "<HHI", tag, kind, len(values)) + raw.ljust(room, b"\0"))
        start = place(struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + struct.pack(offset, 0))
        body[link : link + room] = struct.pack(offset, start)
        link = len(body) - room
    return bytes(body)


def write_scan(voxels: DataFrame, path: str, pages_each: int = 64, kind: str = "u2", big: bool = False, tile: tuple[int, int] | None = (64, 64), deflate: bool = True) -> None:
    """Writes (n, row, col, u) as TIFF files of ``pages_each`` pages each to a folder that pyarrow knows; places without a voxel are 0. A task holds the pages of one file. n starts at 0; pages without a voxel are written too.

    Raises ValueError on a value that ``kind`` can't hold: beyond 0 to 65535 or null (u2), or a whole number that 32-bit floats have no room for. A null is NaN in pages of floats.
    """
    size = voxels.agg(F.max("row") + 1, F.max("col") + 1, F.max("n") + 1).first()
    if size[0] is None:
        return
    height, width, images = size
    files, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    files.create_dir(place, recursive=True)

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        n, row, col, u = (c.to_numpy() for c in table.filter(table.column("n").is_valid()).select(["n", "row", "col", "u"]).columns)
        held = u.astype(np.float64)
        if kind == "u2" and not ((held >= 0) & (held < 65536)).all():
            raise ValueError("a value is not within 0 to 65535: write floats (f4)")
        with np.errstate(over="ignore"):
            kept = held.astype(kind)
        if ((held == np.rint(held)) & (kept != held)).any():
            raise ValueError("a whole number is too large for 32-bit floats")
        stack = np.zeros((min(pages_each, images - part * pages_each), height, width), kind)
        stack[n - part * pages_each, row, col] = kept
        files, here = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        name = f"{here}/pages-{part:08d}.tif"
        with files.open_output_stream(name + ".part") as out:
            out.write(encode(stack, big, tile, deflate))
        files.move(name + ".part", name)
        return pa.table({"part": pa.array([part], pa.int32())})

    parts = voxels.select("n", "row", "col", F.col("u").cast("double").alias("u"), F.floor(F.col("n") / pages_each).cast("int").alias("part"))
    every = voxels.sparkSession.range(-(-images // pages_each)).select(F.col("id").cast("int").alias("part"))
    parts.unionByName(every, allowMissingColumns=True).groupBy("part").applyInArrow(write, "part int").write.format("noop").mode("overwrite").save()


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, row, col, u) of all stacks at ``path``, a page at a time, through Spark's binary source: whole files of up to 2 GB, from any store that Spark reads. ``stacked`` numbers the pages on."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                for n, page in enumerate(each_page(bytes(content))):
                    row, col = np.indices(page.shape, dtype=np.int32)
                    yield pd.DataFrame({"path": name, "n": np.int32(n), "row": row.ravel(), "col": col.ravel(), "u": page.ravel().astype(np.float64)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, n int, row int, col int, u double")


def stacked(pages: DataFrame) -> DataFrame:
    """(n, row, col, u) of one volume from the stacks of ``read_stacks``: the pages of all files in order of their names. Raises ValueError if pages differ in size."""
    sizes = pages.groupBy("path").agg((F.max("n") + 1).alias("count"), (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    found = sorted((r["path"], r["count"], r["h"], r["w"]) for r in sizes.collect())  # a row for each file
    if len({(h, w) for *_, h, w in found}) > 1:
        raise ValueError(f"pages differ in size: {sorted({(h, w) for *_, h, w in found})}")
    before, total = [], 0
    for path, count, *_ in found:
        before.append((path, total))
        total += count
    first = pages.sparkSession.createDataFrame(before, "path string, first int")
    return pages.join(F.broadcast(first), "path").select((F.col("n") + F.col("first")).alias("n"), "row", "col", "u")
