"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is part of what one task gathers from its partition (up to ``SHARD_ROWS`` or ``SHARD_BYTES``), cut at ``SHARD_SYMBOLS``. Words become numbers of the benchmark's vocabulary; runs of such words
that are too short for any window are left out, as no window can lie in them. The windows of the benchmark's items are searched backwards all at once,
their occurrences located by sampled suffix positions, and overlapping occurrences merged into removal spans.

The benchmark is cut into blocks of about ``BLOCK_BYTES``. Tasks make a block's windows and write them to the shared folder; the driver holds a number for each block. Texts are scanned
once: what a task has gathered is searched for one block after another, and a worker holds one block at a time.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, hashed_words, words
from .common import file_system, for_python, handed_back, run_folder, slices, text_buffer
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_SYMBOLS = 1 << 17
SHARD_ROWS = 1 << 16
SHARD_BYTES = 48 << 20

ADDED = ("n_words", "n_hit", "items", "spans")
#: spans: first and last word of a stretch that is to go, and its bytes in the UTF-8 text (end exclusive).
SPAN = "struct<first_word: long, last_word: long, start: long, end: long>"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Windows:
    vocabulary: np.ndarray  # hashes, ascending; word k + 1 is the number of the k-th
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> windows, then items in CSR form
    items: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW) -> Windows:
        texts = [text.encode() for _, text in items]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, before = hashed_words(np.frombuffer(b"".join(texts), np.uint8), at, ALNUM)
        vocabulary = np.unique(h)
        ids = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
        names = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(names)}
        number = np.array([place[i] for i, _ in items], np.int64)
        count = np.diff(before)
        length, by_length = np.minimum(count, window), {}
        for n in np.unique(length[length > 0]).tolist():
            rows = np.flatnonzero(length == n)
            many = count[rows] - n + 1
            begin = np.repeat(before[rows] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            found = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, n)[begin])
            windows, which = np.unique(found.view(np.dtype((np.void, 4 * n))).ravel(), return_inverse=True)
            pairs = np.unique(which * len(names) + np.repeat(number[rows], many))
            at_item = np.searchsorted(pairs // len(names), np.arange(len(windows) + 1))
            by_length[n] = (windows.view(np.int32).reshape(-1, n), at_item, pairs % len(names))
        return cls(vocabulary, by_length, names)


def write_windows(items: DataFrame, folder: str, blocks: int, window: int) -> list[str]:
    """Makes the windows of ``items`` (item, text) block by block on the executors and returns the files. A file is moved to its name when whole, so a task that is run again leaves the same one."""

    def make(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        made = Windows.of(sorted(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True)), window)
        files, here = file_system(folder)
        files.create_dir(here, recursive=True)
        own = f"{here}/{uuid.uuid4().hex}"
        with files.open_output_stream(own) as f:
            f.write(pickle.dumps(made, 5))
        files.move(own, f"{here}/windows-{k}")
        return pa.table({"k": pa.array([k], pa.int32())})

    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")
    done = items.distinct().withColumn("k", block).groupBy("k").applyInArrow(make, "k int").collect()
    return [f"{folder}/windows-{k}" for k in sorted(r[0] for r in done)]


_loaded: dict[str, Windows] = {}


def load_windows(path: str) -> Windows:
    """A block's windows; a worker keeps the last one that it read."""
    if path not in _loaded:
        _loaded.clear()
        files, here = file_system(path)
        with files.open_input_file(here) as f:
            _loaded[path] = pickle.loads(f.read())
    return _loaded[path]


class Shard:
    """Gathers documents' runs of benchmark words, then searches them."""

    def __init__(self, windows: Windows):
        self.windows, self.least = windows, min(windows.by_length, default=1)
        self.symbols: list[np.ndarray] = []
        self.where: list[tuple[np.ndarray, ...]] = []  # document, word, start and end byte of each symbol
        self.n_symbols = self.n_docs = 0
        self.n_words: list[np.ndarray] = []

    def add(self, data: np.ndarray, at: np.ndarray) -> None:
        h, before = hashed_words(data, at, ALNUM)
        self.n_words.append(np.diff(before))
        v = self.windows.vocabulary
        if len(h) and len(v):
            place = np.searchsorted(v, h)
            ids = np.where(v[np.minimum(place, len(v) - 1)] == h, place + 1, 0).astype(np.int32)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(before))
            begins = np.ones(len(h), bool)
            begins[1:] = (doc[1:] != doc[:-1]) | ((ids[1:] > 0) != (ids[:-1] > 0))
            run = np.cumsum(begins) - 1
            keep = (ids > 0) & (np.bincount(run)[run] >= self.least)
            if keep.any():
                starts, ends, _ = words(data, at, ALNUM)
                kept = np.flatnonzero(keep)
                first = np.flatnonzero(begins[kept])  # a separator goes before each run but the first
                row = doc[kept]
                columns = (ids[kept], row + self.n_docs, kept - before[row], starts[kept] - at[row], ends[kept] - at[row])
                columns = [np.append(np.insert(x, first[first > 0], 0), 0) for x in columns]
                self.symbols.append(columns[0])
                self.where.append(tuple(columns[1:]))
                self.n_symbols += len(columns[0])
        self.n_docs += len(at) - 1

    def search(self) -> tuple[np.ndarray, dict[int, list[int]], dict[int, list[dict]]]:
        """Words, and of the documents with a window, items and spans."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        items, spans = {}, {}
        if self.symbols:
            text = np.concatenate(self.symbols)
            doc, word, start, end = (np.concatenate(x) for x in zip(*self.where, strict=True))
            index = FMIndex(text)
            cover, pairs = np.zeros(len(text) + 1, np.int64), []
            for n, (patterns, item_at, item_of) in self.windows.by_length.items():
                which, low, high = index.search(patterns)
                many = high - low
                rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
                position = index.locate(rows)
                np.add.at(cover, position, 1)
                np.add.at(cover, position + n, -1)
                seen = np.unique(np.repeat(which, many) * self.n_docs + doc[position]) if len(position) else np.zeros(0, np.int64)
                w, d = seen // max(1, self.n_docs), seen % max(1, self.n_docs)
                count = item_at[w + 1] - item_at[w]
                of = np.repeat(item_at[w] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(w) else np.zeros(0, np.int64)
                pairs.append(np.repeat(d, count) * len(self.windows.items) + item_of[of] if len(w) else np.zeros(0, np.int64))
            hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            for x in np.unique(np.concatenate(pairs)).tolist():
                items.setdefault(x // len(self.windows.items), []).append(x % len(self.windows.items))
            if len(hit):
                cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(doc[hit]) != 0)) + 1
                for part in np.split(hit, cut):
                    a, b = part[0], part[-1]
                    spans.setdefault(int(doc[a]), []).append({"first_word": int(word[a]), "last_word": int(word[b]), "start": int(start[a]), "end": int(end[b])})
        return n_words, items, spans


Part = tuple[np.ndarray, np.ndarray]


def search_block(windows: Windows, parts: list[Part]) -> tuple[np.ndarray, dict[int, set[str]], dict[int, list[dict]]]:
    """Words of each document of ``parts`` (bytes and offsets); items and spans of those that hold a window of the block."""
    n_words, items, spans, base = [np.zeros(0, np.int64)], {}, {}, 0
    shard = Shard(windows)
    for k, (data, at) in enumerate(parts):
        shard.add(data, at)
        if shard.n_symbols > SHARD_SYMBOLS or k + 1 == len(parts):
            own_words, own_items, own_spans = shard.search()
            n_words.append(own_words)
            items |= {base + d: {windows.items[x] for x in found} for d, found in own_items.items()}
            spans |= {base + d: found for d, found in own_spans.items()}
            base += shard.n_docs
            shard = Shard(windows)
    return np.concatenate(n_words), items, spans


def _scan(docs: DataFrame, blocks: list[str], text: str, cols: list[str]) -> DataFrame:
    rows, back = for_python(docs, cols, text)
    schema = docs.select(*back, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(f"array<{SPAN}>").alias("spans")).schema
    span_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")]))

    def found(held: list[pa.RecordBatch], parts: list[Part]) -> pa.RecordBatch:
        items: dict[int, set[str]] = {}
        spans: dict[int, list[dict]] = {}
        n_words = None
        for path in blocks or [None]:
            n_words, own_items, own_spans = search_block(load_windows(path) if path else Windows.of([]), parts)
            for d, x in own_items.items():
                items.setdefault(d, set()).update(x)
            for d, x in own_spans.items():
                spans[d] = merge_spans(spans[d] + x) if d in spans else x
        n = len(n_words)
        n_hit = np.zeros(n, np.int64)
        for d, x in spans.items():
            n_hit[d] = sum(s["last_word"] - s["first_word"] + 1 for s in x)
        columns = [pa.concat_arrays(x) for x in zip(*(handed_back(b, back, text) for b in held), strict=True)]
        columns += [pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())), pa.array([spans.get(d, []) for d in range(n)], span_type)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, n_rows, n_bytes = [], [], 0, 0
        for batch in batches:
            raw, at = text_buffer(batch.column(batch.num_columns - 1))
            for a, b in slices(at):
                parts.append((raw[at[a] : at[b]], at[a : b + 1] - at[a]))
                held.append(batch.slice(a, b - a))
                n_rows, n_bytes = n_rows + b - a, n_bytes + at[b] - at[a]
                if n_rows > SHARD_ROWS or n_bytes > SHARD_BYTES:
                    yield found(held, parts)
                    held, parts, n_rows, n_bytes = [], [], 0, 0
        if parts:
            yield found(held, parts)

    return rows.mapInArrow(work, schema).select(*cols, *ADDED)


def merge_spans(spans: list[dict]) -> list[dict]:
    """Spans that overlap or touch become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first_word"], s["last_word"])):
        if out and s["first_word"] <= out[-1]["last_word"] + 1:
            if s["last_word"] > out[-1]["last_word"]:
                out[-1] = out[-1] | {"last_word": s["last_word"], "end": s["end"]}
        else:
            out.append(dict(s))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of ``docs`` (all but the text if None) with n_words, n_hit, items (ids as strings, in order) and spans to remove.

    Defined cases: null and empty texts have no words; an item without words has no window; an item shorter than ``window`` is one window; of a repeated
    item id all texts count, as one item; a null item id is named "null"; columns of ``docs`` named like an added one are replaced.
    """
    cols = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in ADDED]
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = write_windows(items, run_folder(docs.sparkSession, "windows"), -(-size // block_bytes) or 1, window)
    return _scan(docs, blocks, text, cols)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Which of all ``documents`` hold ten words in a row of a ``benchmark`` item."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, keep=["doc_id"])
    ids = F.concat_ws(",", F.array_sort("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS ws FROM documents),
it AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, ws, least({WINDOW}, len(ws)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM it)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
occ AS (SELECT places.doc_id, places.i, places.n, item FROM places JOIN win ON places.n = win.n AND places.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""
