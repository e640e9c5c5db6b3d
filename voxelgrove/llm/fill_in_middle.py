"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME`` bytes, cut after a unit wherever one ends in reach, with the units and code points that lie before each frame. A unit
is a word with the white space before it, or white space at the end. A cut after so many units is found from these counts: only the frame that it falls in is
decompressed. The output is put together by going through the stored frames in the output's order, one frame in memory at a time, and is stored as frames itself; its digest
and that of the text restored from it (found again by its markers, gone through in the text's order) come from the same streams.

``store_frames`` and ``fill_in_middle`` are narrow: no shuffle, one row for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACED, words
from .common import by_slice, for_python, handed_back, written

FRAME = 1 << 16
LEVEL = 3
SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = MARKERS = (b"<P>", b"<S>", b"<M>")
STORED = "frames array<binary>, sizes array<bigint>, units array<bigint>, chars array<bigint>, marked boolean"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output_frames", "frames", "sizes", "units", "chars", "marked")

_compress = zstandard.ZstdCompressor(level=LEVEL)
_decompress = zstandard.ZstdDecompressor()


def packed(data: bytes) -> bytes:
    """An independent frame."""
    return _compress.compress(data)


def code_points(data: np.ndarray) -> int:
    """Code points that begin in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def unit_ends(data: np.ndarray, more: int) -> np.ndarray:
    """Where units end in a frame that has ``more`` ends in all: behind each word that white space follows, and at the frame's own end if one is left."""
    inside = SPACED[data]
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return np.append(ends, len(data)) if len(ends) < more else ends


def frame_edges(size: int, ends: np.ndarray, frame: int) -> list[int]:
    """Where frames end: after the last unit in reach, or in the middle of one that is longer than a frame."""
    edges, at = [], 0
    while at < size:
        k = int(np.searchsorted(ends, at + frame, side="right"))
        at = int(ends[k - 1]) if k and ends[k - 1] > at else min(size, at + frame)
        edges.append(at)
    return edges


class Frames:
    """A stored text: decompresses a frame at a time, forward or at a cut."""

    def __init__(self, frames: list[bytes], sizes: np.ndarray, units: np.ndarray | None = None, chars: np.ndarray | None = None):
        self.frames, self.units, self.chars = frames, units, chars
        self.begins = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)

    def read(self, k: int) -> bytes:
        return _decompress.decompress(self.frames[k])

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which ``unit`` units end; decompresses one frame at most."""
        if unit == 0:
            return 0, 0
        k = int(np.searchsorted(self.units, unit, side="left")) - 1
        data = np.frombuffer(self.read(k), np.uint8)
        ends = unit_ends(data, int(self.units[k + 1] - self.units[k]))
        at = int(ends[unit - int(self.units[k]) - 1])
        return int(self.begins[k]) + at, int(self.chars[k]) + code_points(data[:at])

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from start to end, frame by frame."""
        k = max(0, int(np.searchsorted(self.begins, start, side="right")) - 1)
        while start < end and k < len(self.frames):
            low, high = int(self.begins[k]), int(self.begins[k + 1])
            data = self.read(k)
            yield data[max(start, low) - low : min(end, high) - low]
            start, k = high, k + 1

    def find(self, marker: bytes) -> int:
        """The first place of ``marker``, also across frames; -1 if there is none."""
        tail, at = b"", 0
        for k in range(len(self.frames)):
            data = tail + self.read(k)
            found = data.find(marker)
            if found >= 0:
                return at + found
            keep = min(len(data), len(marker) - 1)
            tail, at = data[len(data) - keep :], at + len(data) - keep
        return -1


class Writer:
    """Frames of a stream, with the stream's digest; holds less than two frames."""

    def __init__(self, frame: int):
        self.frame, self.waiting, self.frames, self.sizes, self.digest = frame, bytearray(), [], [], sha256()

    def write(self, data: bytes) -> None:
        self.digest.update(data)
        self.waiting += data
        while len(self.waiting) >= self.frame:
            self._put(bytes(self.waiting[: self.frame]))
            del self.waiting[: self.frame]

    def _put(self, data: bytes) -> None:
        self.frames.append(packed(data))
        self.sizes.append(len(data))

    def end(self) -> Frames:
        if self.waiting:
            self._put(bytes(self.waiting))
            self.waiting.clear()
        return Frames(self.frames, np.array(self.sizes, np.int64))


def output_order(form: str, size: int, a: int, b: int) -> list[bytes | tuple[int, int]]:
    """What an output consists of: markers and byte ranges of the text, cut at a and b."""
    prefix, middle, suffix = (0, a), (a, b), (b, size)
    if form == "psm":
        return [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
    return [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle] if form == "spm" else [(0, size)]


def restored_ranges(output: Frames, form: str) -> list[tuple[int, int]]:
    """Byte ranges of an output that give the text, found by its markers alone."""
    size = int(output.begins[-1])
    if form == "plain":
        return [(0, size)]
    p, s, m = (output.find(x) for x in MARKERS)
    if form == "psm":
        return [(p + 3, s), (m + 3, size), (s + 3, m)]
    return [(p + 3, m), (m + 3, size), (s + 3, p)]


def store_frames(docs: DataFrame, text: str = "text", keep: list[str] | None = None, frame: int = FRAME) -> DataFrame:
    """``keep`` columns (all but the text if None) and the text's frames: frames, sizes (bytes of each), units and chars (that lie before each, and in all, last) and marked (it contains a marker).

    A null text is stored as an empty one: no frame. Columns of ``docs`` named like an added one are replaced.
    """
    cols = [c for c in (keep if keep is not None else docs.columns) if c not in ADDED and c != text]
    rows, back = for_python(docs, cols, text)
    schema = docs.sparkSession.createDataFrame([], STORED).schema
    for c in reversed(cols):
        schema = type(schema)([docs.schema[c], *schema.fields])

    def work(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        _, ends, before = words(data, at, SPACED)
        out: list[list] = [[] for _ in range(5)]
        for i in range(part.num_rows):
            own = data[at[i] : at[i + 1]]
            stops = ends[before[i] : before[i + 1]] - at[i]
            if len(own) and not SPACED[own[-1]]:
                stops = np.append(stops, len(own))
            edges = frame_edges(len(own), stops, frame)
            raw, begins = own.tobytes(), [0, *edges]
            out[0].append([packed(raw[a:b]) for a, b in zip(begins, edges)])  # noqa: B905
            out[1].append([b - a for a, b in zip(begins, edges)])  # noqa: B905
            out[2].append(np.searchsorted(stops, begins, side="right").tolist())
            out[3].append(np.cumsum([0, *(code_points(own[a:b]) for a, b in zip(begins, edges))]).tolist())  # noqa: B905
            out[4].append(any(m in raw for m in MARKERS))
        kinds = (pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3, pa.bool_())
        return pa.RecordBatch.from_arrays([*handed_back(part, back, text), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], schema.names)

    return rows.mapInArrow(by_slice(work, "_text"), schema)


def choose(code: str, n: int, marked: bool, rate: int = RATE, spm: int = SPM) -> tuple[str, int, int]:
    """Form and the two cuts, in units, from the hexadecimal digest of a document."""
    h1, h2, h3, h4 = (int(code[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if n == 0 or marked or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
    return form, a, b


def fill_in_middle(stored: DataFrame, doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM, frame: int = FRAME, outputs: bool = True) -> DataFrame:
    """The columns of a table of ``store_frames`` but its frames, with n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with ``outputs``, output_frames: the
    transformed text as zstandard frames, which ``output_text`` puts together.

    Defined cases: a null or empty text is plain with n = 0; a null id counts as empty text; rows that repeat an id get the same numbers, so equal rows get equal results; a text that contains a
    marker stays plain; an empty table stays empty.
    """
    drop = {x.split()[0] for x in STORED.split(", ")}
    cols = [c for c in stored.columns if c not in drop]
    rows = stored.select(*[F.col(f"`{c}`") for c in cols], F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256).alias("_code"), *drop)
    added = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + ", output_frames array<binary>" * outputs
    fresh = stored.sparkSession.createDataFrame([], added).schema
    schema = type(fresh)([*(stored.schema[c] for c in cols), *fresh.fields])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.binary())] * outputs)

    def one(code: str, source: Frames, marked: bool) -> tuple:
        n, size = int(source.units[-1]), int(source.begins[-1])
        form, u, v = choose(code, n, marked, rate, spm)
        (a, a_chars), (b, b_chars) = (source.cut(u), source.cut(v)) if form != "plain" else ((0, 0), (0, 0))
        writer = Writer(frame)
        for part in output_order(form, size, a, b):
            for data in [part] if isinstance(part, bytes) else source.stream(*part):
                writer.write(data)
        output, again = writer.end(), sha256()
        for span in restored_ranges(output, form):
            for data in output.stream(*span):
                again.update(data)
        chars = (None, None) if form == "plain" else (a_chars, b_chars - a_chars)
        return n, form, *chars, writer.digest.hexdigest(), again.hexdigest(), *[output.frames] * outputs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                code, frames, sizes, units, chars, marked = (b.column(b.schema.get_field_index(c)) for c in ("_code", "frames", "sizes", "units", "chars", "marked"))
                found = [
                    one(code[i].as_py(), Frames(frames[i].as_py(), sizes[i].values.to_numpy(), units[i].values.to_numpy(), chars[i].values.to_numpy()), marked[i].as_py()) for i in range(b.num_rows)
                ]
                made = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *made], schema.names)

    return rows.mapInArrow(work, schema)


def output_text(frames: list[bytes]) -> str:
    """The text of an output's frames."""
    return b"".join(map(_decompress.decompress, frames)).decode()


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, stored as frames in the shared folder and transformed from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = written(store_frames(docs, keep=["doc_id"]), "frames")
    return fill_in_middle(stored, outputs=False)


OP11_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
