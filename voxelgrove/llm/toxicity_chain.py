"""Toxicity by a classifier chain: categories are predicted one after the other by linear models, each given the probabilities of the earlier ones.

In training those probabilities are out of fold: a document's come from models that did not see it, as later they come for documents no model has seen.
Each model is a ridge-penalised logistic regression over the presence of the hashed words that tell the category best, and the earlier probabilities.

Labels say toxic or not; the categories before it are learnt: the words that tell toxic documents from others, in any language, are parted into groups that occur in the
same documents, and a toxic document is of a group's category if it has one of its words. A caller may give words for categories instead. The verdict's threshold is the one
with the best F1 among out-of-fold probabilities.

Bounds: the fit sees at most ``SAMPLE`` labelled rows as hashed words, of these at most ``SAMPLE_BYTES``; a model has ``WORDS`` words at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, hashed_words
from .common import blob, bounded_sample, by_slice, for_python, handed_back, held_out, within_bytes, written
from .features import text_features

SAMPLE = 12_000
SAMPLE_BYTES = 64 << 20
#: What a row counts besides its features, so that rows without any are bounded too.
ROW_BYTES = 64
WORD_BITS = 20
WORDS = 192
FOLDS = 5
RIDGE = 1.0
#: Groups of words that are learnt, and the words that are grouped.
GROUPS = ("group_1", "group_2", "group_3")
GROUPED = 96
TARGET = "toxic"


@dataclass
class Link:
    """One model of the chain."""

    words: np.ndarray  # buckets, ascending
    weights: np.ndarray  # of the words, then of the earlier probabilities, then the constant


@dataclass
class Chain:
    names: list[str]
    links: list[Link]
    threshold: float


def _presence(rows: np.ndarray, buckets: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    x = np.zeros((n, len(words)))
    if len(words) and len(buckets):
        at = np.minimum(np.searchsorted(words, buckets), len(words) - 1)
        hit = words[at] == buckets
        x[rows[hit], at[hit]] = 1.0
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling_words(rows: np.ndarray, buckets: np.ndarray, n: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and how far their positives are from what the frequency alone would give, in standard deviations; a word of few documents tells nothing."""
    positive = y[rows] > 0.5
    distinct, at = np.unique(buckets, return_inverse=True)
    a = np.bincount(at[positive], minlength=len(distinct)).astype(float)
    df = np.bincount(at, minlength=len(distinct)).astype(float)
    share = y.mean() if n else 0.0
    return distinct, np.where(df >= 3, (a - df * share) / np.sqrt(df * max(share * (1 - share), 1e-6) + 1), 0)


def fit_link(rows: np.ndarray, buckets: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray) -> Link:
    """rows and buckets: the words of n documents; earlier: n x categories before this one; y: 0 or 1."""
    distinct, gain = telling_words(rows, buckets, n, y)
    gain = np.abs(gain)
    best = np.argsort(-gain, kind="stable")[:WORDS]
    words = np.sort(distinct[best[gain[best] > 1]])
    x = np.concatenate([_presence(rows, buckets, n, words), earlier, np.ones((n, 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return Link(words, w)


def apply_link(link: Link, rows: np.ndarray, buckets: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    x = np.concatenate([_presence(rows, buckets, n, link.words), earlier, np.ones((n, 1))], axis=1)
    return _sigmoid(x @ link.weights)


def learn_groups(rows: np.ndarray, buckets: np.ndarray, n: int, y: np.ndarray, groups: int) -> list[np.ndarray]:
    """The most telling words of positive documents in ``groups`` sets of buckets: each word joins the group whose seed it shares most documents with."""
    distinct, gain = telling_words(rows, buckets, n, y)
    best = np.argsort(-gain, kind="stable")[:GROUPED]
    words = np.sort(distinct[best[gain[best] > 3]])
    x = _presence(rows, buckets, n, words)[y > 0.5]
    size = np.sqrt(np.maximum(1e-9, x.sum(axis=0)))
    like = (x.T @ x) / size[:, None] / size[None, :]
    seeds: list[int] = []
    for _ in range(min(groups, len(words))):  # the most frequent word, then the most frequent one among those least like the seeds
        apart = 1 - like[:, seeds].max(axis=1) if seeds else np.ones(len(words))
        seeds.append(int(np.argmax(apart * size)))
    of = np.argmax(like[:, seeds], axis=1) if seeds else np.zeros(0, np.int64)
    return [words[of == g] for g in range(groups)]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a verdict has the best F1: midway between the last accepted and the first rejected."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    ends = np.append(p[1:] < p[:-1], True)
    f1 = np.where(ends, 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum())), -1)
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def _out_of_fold(rows: np.ndarray, buckets: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, folds: np.ndarray) -> np.ndarray:
    out = np.full(n, y.mean())
    for f in np.unique(folds):
        test = folds == f
        if test.all():
            continue
        number, own, seen = np.cumsum(~test) - 1, np.cumsum(test) - 1, ~test[rows]
        link = fit_link(number[rows[seen]], buckets[seen], int((~test).sum()), earlier[~test], y[~test])
        out[test] = apply_link(link, own[rows[~seen]], buckets[~seen], int(test.sum()), earlier[test])
    return out


def fit_chain(docs: list[np.ndarray], y: np.ndarray, folds: np.ndarray, names: list[str], words: list[np.ndarray] | None = None) -> Chain:
    """docs: word buckets of each; y: 0 or 1; folds: of each document, copies in the same one; names: the categories, the last being y itself; words: buckets of each but the last, learnt if None."""
    n, y = len(docs), y.astype(float)
    rows, buckets = np.repeat(np.arange(n), [len(d) for d in docs]), np.concatenate(docs)
    if words is None:
        words = learn_groups(rows, buckets, n, y, len(names) - 1)
    targets = [y * (_presence(rows, buckets, n, np.unique(w)).any(axis=1) if len(w) else 0.0) for w in words] + [y]
    earlier, links = np.zeros((n, 0)), []
    for target in targets:
        links.append(fit_link(rows, buckets, n, earlier, target))
        out = _out_of_fold(rows, buckets, n, earlier, target, folds)
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return Chain(names, links, best_threshold(earlier[:, -1], y))


def word_buckets(words: tuple[str, ...]) -> np.ndarray:
    raw = " ".join(words).encode()
    h, _ = hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, ...]] | None, text: str, doc_id: str, label: str, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Chain | None:
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    drawn = bounded_sample(known, ["id"], sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
    # Folds go by the text, so that copies are never on both sides.
    rows = rows.select(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold"), "y", "text")

    def words(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        row, bucket, _ = text_features(data, at, WORD_BITS)
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([blob(bucket[a:b].astype(np.int32)) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["fold", "y", "words"])

    made = written(rows.mapInArrow(by_slice(words, "text"), "fold int, y int, words binary"), "toxicity_features")
    got = sorted((bytes(r[2]), r[0], r[1]) for r in within_bytes(made, ["words", "y"], F.octet_length("words") + ROW_BYTES, most_bytes).collect())
    if not got:
        return None
    given = None if categories is None else [word_buckets(w) for w in categories.values()]
    return fit_chain([np.frombuffer(w, np.int32).astype(np.int64) for w, *_ in got], np.array([y for *_, y in got]), np.array([f for _, f, _ in got]), _names(categories), given)


def _names(categories: dict[str, tuple[str, ...]] | None) -> list[str]:
    return [*(GROUPS if categories is None else categories), TARGET]


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, ...]] | None = None, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with p_<category> of each category in the order of the chain, the last being p_toxic, and toxic (0 or 1), the verdict.

    ``categories``: words by category; learnt if None. Defined cases: null and empty texts have no words and all get the same probabilities; labels that are null or neither
    0 nor 1 are not learnt from; of an id's several labels the highest counts; with no label every probability and verdict is 0; columns of ``docs`` named like an
    added one are replaced.
    """
    probabilities = [f"p_{c}" for c in _names(categories)]
    added = [*probabilities, "toxic"]
    cols = [c for c in (keep or docs.columns) if c not in added]
    chain = fit(docs, labels, categories, text, doc_id, label)
    if chain is None:
        return docs.select(*cols, *[F.lit(0.0).alias(c) for c in probabilities], F.lit(0).alias("toxic"))
    rows, back = for_python(docs, cols, text)

    def work(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        n = batch.num_rows
        row, bucket, _ = text_features(data, at, WORD_BITS)
        p = np.zeros((n, 0))
        for link in chain.links:
            p = np.concatenate([p, apply_link(link, row, bucket, n, p)[:, None]], axis=1)
        return pa.RecordBatch.from_arrays([*handed_back(batch, back, text), *[pa.array(x, pa.float64()) for x in p.T], pa.array((p[:, -1] >= chain.threshold).astype(np.int32))], [*back, *added])

    return rows.mapInArrow(by_slice(work, "_text"), docs.select(*back, *[F.lit(0.0).alias(c) for c in probabilities], F.lit(0).alias("toxic")).schema).select(*cols, *added)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``: probabilities by category and the verdict, learnt from labelled rows that are not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_toxicity(docs, labels.where(~held_out("doc_id")), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), *[c for c in found.columns if c != "doc_id"])
