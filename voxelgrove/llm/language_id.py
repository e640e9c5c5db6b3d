"""Language identification with string kernels.

The kernel of two texts is the weighted number of n-grams of 1 to 3 characters that both hold (presence, not counts), divided by the root of the
product of their own kernels. Landmark texts give a Nyström map, on which a kernel ridge regression is fitted one language against the rest.
Documents are scored in batches: a presence matrix times the landmarks' matrix times the coefficients.

Bounds: the fit sees a sample of at most ``SAMPLE`` labelled rows, ``LANDMARKS`` of them as landmarks; n-grams are hashed to a fixed number of buckets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob, bounded_sample, for_python, handed_back, held_out, written

SAMPLE = 3000
LANDMARKS = 96
#: Buckets of the n-grams of 1, 2 and 3 characters, and each order's weight in the kernel.
BUCKETS = (1 << 12, 1 << 16, 1 << 18)
WEIGHTS = (1.0, 1.0, 1.0)
EDGES = np.cumsum((0, *BUCKETS))
RIDGE = 1e-2
SHARPNESS = 3.0
BATCH = 256
PIECE = 1 << 20
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def mark(text: str, flags: np.ndarray) -> np.ndarray:
    """Sets the buckets of the text's n-grams in ``flags``; returns them, with repeats, to be unset."""
    text = text.lower()
    found = []
    for i in range(0, max(1, len(text)), PIECE):
        c = np.frombuffer(text[i : i + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = c
        for n, size in enumerate(BUCKETS):
            if n:
                codes = codes[:-1] * np.uint32(0x01000193) + c[n:]
            if not len(codes):
                break
            h = codes * np.uint32(0x9E3779B1)
            at = (h >> np.uint32(33 - size.bit_length())).astype(np.int32) + np.int32(EDGES[n])
            flags[at] = 1
            found.append(at)
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def own_kernel(flags: np.ndarray) -> float:
    return float(sum(w * np.count_nonzero(flags[a:b]) for w, a, b in zip(WEIGHTS, EDGES, EDGES[1:], strict=False)))


@dataclass
class Landmarks:
    buckets: np.ndarray  # those that any landmark holds, ascending
    matrix: np.ndarray  # buckets x landmarks, weighted and divided by the root of the landmark's own kernel

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        buckets = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int32)
        weights = np.asarray(WEIGHTS, np.float32)[np.searchsorted(EDGES, buckets, side="right") - 1]
        matrix = np.zeros((len(buckets), len(sets)), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(buckets, s)
            matrix[at, k] = weights[at] / max(1e-9, np.sqrt(weights[at].sum()))
        return cls(buckets, matrix)

    def kernels(self, texts: list[str | None]) -> np.ndarray:
        """texts x landmarks."""
        flags = np.zeros(EDGES[-1], np.uint8)
        x = np.zeros((len(texts), len(self.buckets)), np.float32)
        for k, text in enumerate(texts):
            if text:
                at = mark(text, flags)
                x[k] = flags[self.buckets]
                x[k] /= np.float32(np.sqrt(max(1e-9, own_kernel(flags))))
                flags[at] = 0
        return x @ self.matrix


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    coefficients: np.ndarray  # landmarks x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        f = self.landmarks.kernels(texts) @ self.coefficients
        e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lang, score = [self.languages[k] for k in best], p[np.arange(len(best)), best].astype(float).tolist()
        for k, text in enumerate(texts):
            if not has_letter(text):
                lang[k], score[k] = UNKNOWN, 0.0
        return lang, score


def fit(train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """None if no row has a text and a language."""
    spark = train.sparkSession
    rows = train.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    drawn = written(bounded_sample(rows, ["id", "lang"], sample), "language_sample")
    order = sorted(((r[0], r[1], r[2]) for r in drawn.select(F.xxhash64("id", "text").alias("h"), "lang", "id").collect()), key=lambda r: (r[0], r[1], str(r[2])))
    if not order:
        return None
    count = Counter(r[1] for r in order)
    languages = [k for k, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    share = max(1, landmarks // len(languages))
    chosen, seen = [], Counter()
    for h, language, _ in order:
        if seen[language] < share and len(chosen) < max(landmarks, len(languages)):
            seen[language] += 1
            chosen.append((h, language))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(EDGES[-1], np.uint8)
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                at = mark(t, flags)
                out.append(blob(np.flatnonzero(flags).astype(np.int32)))
                flags[at] = 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["buckets"])

    picked = spark.createDataFrame(chosen, "h long, lang string").distinct()
    at = drawn.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(picked), ["h", "lang"], "left_semi").select("text").distinct()
    marks = Landmarks.of(sorted((np.frombuffer(r[0], np.int32) for r in at.mapInArrow(sets, "buckets binary").collect()), key=lambda a: (len(a), a.tobytes())))

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                s = b.slice(i, BATCH)
                k = marks.kernels(s.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([blob(x) for x in k], pa.binary())], ["lang", "k"])

    got = sorted((r[0], r[1]) for r in drawn.select("lang", "text").mapInArrow(kernels, "lang string, k binary").collect())
    k_nm = np.stack([np.frombuffer(x, np.float32) for _, x in got]).astype(np.float64)
    y = np.full((len(got), len(languages)), -1.0)
    y[np.arange(len(got)), [languages.index(x) for x, _ in got]] = 1.0
    # The landmarks' kernel with themselves, from the same matrix.
    weights = np.asarray(WEIGHTS)[np.searchsorted(EDGES, marks.buckets, side="right") - 1]
    unweighted = marks.matrix / weights[:, None].astype(np.float32)
    k_mm = (unweighted.T @ marks.matrix).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = values > 1e-6 * values.max()
    to_map = vectors[:, keep] / np.sqrt(values[keep])
    z = k_nm @ to_map
    beta = np.linalg.solve(z.T @ z + RIDGE * len(got) / 100 * np.eye(z.shape[1]), z.T @ y)
    return Model(languages, marks, (to_map @ beta).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all of them if None) with lang_pred and score."""
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows, back = for_python(docs, names, text)
    schema = docs.select(*back, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                s = b.slice(i, BATCH)
                lang, p = model.predict(s.column(s.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*handed_back(s, back, text), pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*back, "lang_pred", "score"])

    return rows.mapInArrow(score, schema).select(*names, "lang_pred", "score")


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; fitted on rows whose language is known and whose id is not held out.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every row when there is nothing to learn from; ties go to
    the language with more sampled rows; a null id is held out; columns of ``docs`` named lang_pred or score are replaced.
    """
    model = fit(docs.where(~held_out(doc_id)), text, lang, doc_id)
    return predict(docs, model, text, keep)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
