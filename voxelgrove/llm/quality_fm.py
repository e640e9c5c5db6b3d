"""Quality classifier: a factorisation machine over hashed words, structure statistics and numbers that come with a document.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise interactions in time linear in the features.
A word's x is one over the root of the document's distinct words; a bin's x is 1.

Bounds: the fit sees at most ``SAMPLE`` labelled rows, as sparse features made on the executors, and of these at most ``SAMPLE_BYTES``; the model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob, bounded_sample, by_slice, for_python, handed_back, held_out, within_bytes, written
from .features import BINS, STATISTICS, number_bins, text_features

SAMPLE = 10_000
SAMPLE_BYTES = 64 << 20
#: What a row counts besides its features, so that rows without any are bounded too.
ROW_BYTES = 64
WORD_BITS = 14
RANK = 8
EPOCHS = 12
BATCH = 256
RATE = 0.05
DECAY = 1e-4
PREDICT_AT = 0.3


def _sparse(data: np.ndarray, at: np.ndarray, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a slice as CSR: where each begins, columns, values."""
    n = len(at) - 1
    rows, buckets, stats = text_features(data, at, WORD_BITS)
    bins = np.concatenate([stats, *[number_bins(x)[:, None] for x in numbers]], axis=1)
    n_words = np.bincount(rows, minlength=n)
    k = bins.shape[1]
    indptr = np.concatenate([[0], np.cumsum(n_words + k)])
    cols, vals = np.empty(indptr[-1], np.int32), np.ones(indptr[-1], np.float32)
    first = indptr[:-1]
    for j in range(k):
        cols[first + j] = (1 << WORD_BITS) + j * BINS + bins[:, j]
    place = first[rows] + k + np.arange(len(rows)) - np.concatenate([[0], np.cumsum(n_words)])[rows]
    cols[place] = buckets
    vals[place] = 1 / np.sqrt(n_words[rows])
    return indptr, cols, vals


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def sums(self, indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw score, v x by feature, and its sums by row."""
        q = self.v[cols] * vals[:, None]
        s = np.add.reduceat(q, indptr[:-1])
        lin = np.add.reduceat(self.w[cols] * vals, indptr[:-1])
        own = np.add.reduceat(np.einsum("ij,ij->i", q, q), indptr[:-1])
        return self.w0 + lin + 0.5 * (np.einsum("ij,ij->i", s, s) - own), q, s

    def scores(self, indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        raw = self.sums(indptr, cols, vals)[0]
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_features: int, seed: int = 5) -> Model:
    """AdaGrad on the logistic loss; rows: label, columns, values."""
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], np.float32)
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    m = Model(float(np.log(mean / (1 - mean))), np.zeros(n_features, np.float32), rng.normal(0, 0.05, (n_features, RANK)).astype(np.float32))
    gw, gv, g0 = np.full(n_features, 1e-3, np.float32), np.full((n_features, RANK), 1e-3, np.float32), 1e-3
    if y.min() == y.max():
        return m
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            indptr = np.concatenate([[0], np.cumsum([len(rows[k][1]) for k in part])])
            cols, vals = np.concatenate([rows[k][1] for k in part]), np.concatenate([rows[k][2] for k in part])
            raw, q, s = m.sums(indptr, cols, vals)
            g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            gx = np.repeat(g, np.diff(indptr)) * vals
            dw = np.bincount(cols, gx, n_features).astype(np.float32) + DECAY * m.w
            dv = np.empty_like(m.v)
            each = gx[:, None] * (np.repeat(s, np.diff(indptr), axis=0) - q)
            for f in range(RANK):
                dv[:, f] = np.bincount(cols, each[:, f], n_features)
            dv += DECAY * m.v
            gw += dw * dw
            gv += dv * dv
            g0 += float(g.sum()) ** 2
            m.w -= RATE * dw / np.sqrt(gw)
            m.v -= RATE * dv / np.sqrt(gv)
            m.w0 -= RATE * float(g.sum()) / g0**0.5
    return m


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def fit(labelled: DataFrame, docs: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", numbers: tuple[str, ...] = (), sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns ``label`` (0 or 1) of ``labelled`` rows, joined with ``docs`` by id; None if no row has both."""
    names = [f"_n{k}" for k in range(len(numbers))]
    known = labelled.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    drawn = bounded_sample(known, ["id"], sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *[F.col(c).cast("double").alias(n) for c, n in zip(numbers, names, strict=True)])
    rows = rows.join(F.broadcast(drawn), "id").select("id", "y", *names, "text")

    def make(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        indptr, cols, _ = _sparse(data, at, _numbers(batch, names))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([blob(cols[a:b]) for a, b in zip(indptr, indptr[1:], strict=False)], pa.binary())], ["id", "y", "cols"])

    made = written(rows.mapInArrow(by_slice(make, "text"), f"id {dict(rows.dtypes)['id']}, y int, cols binary"), "quality_features")
    got = sorted((r[0], bytes(r[2]), r[1]) for r in within_bytes(made, ["id", "cols"], F.octet_length("cols") + ROW_BYTES, most_bytes).collect())
    if not got:
        return None
    k = len(STATISTICS) + len(numbers)
    return train([(y, c := np.frombuffer(x, np.int32), _values(c, k)) for _, x, y in got], (1 << WORD_BITS) + BINS * k)


def _values(cols: np.ndarray, bins: int) -> np.ndarray:
    """The values that belong to a row's columns: bins first, then words."""
    n = len(cols) - bins
    return np.concatenate([np.ones(bins, np.float32), np.full(n, 1 / np.sqrt(max(1, n)), np.float32)])


def score(docs: DataFrame, model: Model | None, text: str = "text", numbers: tuple[str, ...] = (), keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` (all of them if None) with the score; 0.5 where there was nothing to learn from."""
    cols = [c for c in (keep or docs.columns) if c != name]
    if model is None:
        return docs.select(*cols, F.lit(0.5).alias(name))
    names = [f"_n{k}" for k in range(len(numbers))]
    rows, back = for_python(docs, cols, text, [F.col(c).cast("double").alias(n) for c, n in zip(numbers, names, strict=True)])
    schema = docs.select(*back, F.lit(0.0).alias(name)).schema

    def work(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        p = model.scores(*_sparse(data, at, _numbers(batch, names)))
        return pa.RecordBatch.from_arrays([*handed_back(batch, back, text), pa.array(p, pa.float64())], [*back, name])

    return rows.mapInArrow(by_slice(work, "_text"), schema).select(*cols, name)


def classify_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", numbers: tuple[str, ...] = ("n_chars",), keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier); learnt from labelled rows that are not held out.

    Defined cases: null and empty texts have the same features and so the same score; a null number has a bin of its own; labels that are null or
    neither 0 nor 1 are not learnt from; of an id's several labels the lowest counts; with no label at all every score is 0.5; a column of ``docs`` named score is replaced.
    """
    numbers = tuple(c for c in numbers if c in docs.columns)
    model = fit(labels.where(~held_out(doc_id)), docs, label, text, doc_id, numbers)
    return score(docs, model, text, numbers, keep)


def op2_quality_fm(spark, sf_dir: str) -> DataFrame:
    """A quality score of every whole text of ``documents``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classify_quality(docs, labels, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
