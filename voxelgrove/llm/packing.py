"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Online, in each partition: a level array counts the partially filled windows by fill level, and a piece goes where it makes the sum of the squared
counts least (a new window is level 0; a full one counts no more). A document longer than a window first fills whole windows of its own.
What is open at the end of a partition is joined by cutting pieces, and the last window becomes sequences whose lengths are powers of two: no padding.

A task holds the open windows only (at most ``MOST_OPEN``, which are joined when there are more), and one slice of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer
from .tokens import Encoder, tokenizer_path

LENGTH = 2048
END = 1
MOST_OPEN = 4096
#: Sequence ids of a partition begin at its number times this.
SPAN = 1 << 40
ADDED = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Pieces are (document, start, ids, tokens of the document); ``done`` gets (piece, sequence, offset)."""

    def __init__(self, length: int, base: int, most_open: int = MOST_OPEN):
        self.size, self.next, self.most_open = length, base, most_open
        self.levels = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)  # level -> windows, each a list of pieces
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.done.append((p, self.next, at))
            at += len(p[2])
        self.next += 1

    def level_for(self, s: int) -> int:
        """The level h where a piece of size s makes the sum of squares least; the fullest of equal ones; 0 is a new window."""
        n, top = self.levels, self.size - s
        # Moving a window from h to h+s changes the sum by 2 (n[h+s] - n[h] + 1); filling one up by 1 - 2 n[h]; a new window by 2 n[s] + 1.
        change = 2 * (n[s : self.size + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[s] + 1
        if top:
            change[top] = 1 - 2 * n[top]
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(change[::-1].argmin())

    def add(self, doc: object, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self._close([(doc, start, ids[start : start + self.size], total)])
            start += self.size
        if start == total:
            return
        piece = (doc, start, ids[start:], total)
        s = total - start
        h = self.level_for(s)
        window = []
        if h:
            window = self.open[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        window.append(piece)
        if h + s == self.size:
            self._close(window)
        else:
            self.open[h + s].append(window)
            self.levels[h + s] += 1
            self.n_open += 1
            if self.n_open > self.most_open:
                self.join()

    def join(self, last: bool = False) -> None:
        """Fills the open windows, fullest first, with pieces cut from the emptiest; at most one stays open, none if ``last``."""
        windows = [w for h in sorted(self.open) for w in self.open[h]]  # emptiest first
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        low, high = 0, len(windows) - 1
        room = lambda w: self.size - sum(len(p[2]) for p in w)
        while low < high:
            need = room(windows[high])
            while need and low < high:
                doc, start, ids, total = windows[low].pop()
                if len(ids) > need:
                    windows[low].append((doc, start, ids[:-need], total))
                    start, ids = start + len(ids) - need, ids[-need:]
                windows[high].append((doc, start, ids, total))
                need -= len(ids)
                if not windows[low]:
                    low += 1
            if not need:
                self._close(windows[high])
                high -= 1
        rest = windows[low] if windows and low == high else []
        level = sum(len(p[2]) for p in rest)
        if level == self.size:
            self._close(rest)
        elif rest and not last:
            self.open[level].append(rest)
            self.levels[level] = self.n_open = 1
        elif rest:
            self._powers(rest, level)

    def _powers(self, pieces: list, level: int) -> None:
        for bit in reversed(range(level.bit_length())):
            if level >> bit & 1:
                part, need = [], 1 << bit
                while need:
                    doc, start, ids, total = pieces.pop(0)
                    if len(ids) > need:
                        pieces.insert(0, (doc, start + need, ids[need:], total))
                        ids = ids[:need]
                    part.append((doc, start, ids, total))
                    need -= len(ids)
                self._close(part)


def pack_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = "byte_bpe_50k.json", end: int = END, length: int = LENGTH, most_open: int = MOST_OPEN) -> DataFrame:
    """A row for each piece: ``keep`` columns of ``docs`` (all but the text if None), start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Defined cases: a null or empty text is the end id alone; rows that repeat are packed once each; an empty table gives no piece; columns of ``docs``
    named like an added one are replaced. The documents of a partition are packed in its order, so the same input files give the same sequences.
    """
    cols = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in ADDED]
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("_text"))
    schema = rows.drop("_text").withColumns({"start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids": F.lit(b""), "doc_tokens": F.lit(0).cast("long"), "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path(tokenizer))
        packer = Packer(length, TaskContext.get().partitionId() * SPAN, most_open)
        held: dict[int, pa.RecordBatch] = {}  # rows of ``keep`` by slice, while a piece of them is out

        def out() -> Iterator[pa.RecordBatch]:
            done, packer.done = packer.done, []
            if done:
                groups = sorted({p[0][0] for p, _, _ in done})
                table = pa.Table.from_batches([held[g] for g in groups]) if cols else None
                before = dict(zip(groups, np.cumsum([0, *[held[g].num_rows for g in groups]]), strict=False))
                at = pa.array([before[p[0][0]] + p[0][1] for p, _, _ in done], pa.int64())
                kept = [c.combine_chunks() for c in table.take(at).columns] if cols else []
                numbers = [[p[1] for p, _, _ in done], [len(p[2]) for p, _, _ in done]]
                ids = pa.array([p[2].tobytes() for p, _, _ in done], pa.binary())
                more = [[p[3] for p, _, _ in done], [q for _, q, _ in done], [o for _, _, o in done]]
                whole = [*kept, *[pa.array(x, pa.int64()) for x in numbers], ids, *[pa.array(x, pa.int64()) for x in more]]
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in whole], schema.names)

        group = 0
        for batch in batches:
            raw, at = text_buffer(batch.column(batch.num_columns - 1))
            for a, b in slices(at):
                held[group] = batch.slice(a, b - a).select(list(range(len(cols)))) if cols else None
                ids, begins = encoder.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                for k in range(b - a):
                    packer.add((group, k), np.append(ids[begins[k] : begins[k + 1]], np.uint32(end)))
                yield from out()
                group += 1
                if group % 64 == 0:
                    live = {p[0][0] for ws in packer.open.values() for w in ws for p in w}
                    held = {g: t for g, t in held.items() if g in live}
                    if len(held) > most_open:
                        packer.join()
                        yield from out()
        packer.join(last=True)
        yield from out()

    return rows.mapInArrow(work, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, keep=["doc_id"]).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
