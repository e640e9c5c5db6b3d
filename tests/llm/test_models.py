import math
import re

import numpy as np
from pyspark.sql import functions as F

from voxelgrove.llm import quality_fm, toxicity_chain
from voxelgrove.llm.bytetext import span_hashes
from voxelgrove.llm.features import BINS, text_features
from voxelgrove.llm.language_id import op5_language_id
from voxelgrove.llm.quality_fm import Model, op2_quality_fm
from voxelgrove.llm.toxicity_chain import op8_toxicity

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def test_language_accuracy_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_language_id(spark, SF).where("held_out").collect()
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op2_quality_fm(spark, SF).collect() if r.held_out and r.doc_id in truth]
    good, bad = [r.score for r in rows if truth[r.doc_id]], [r.score for r in rows if not truth[r.doc_id]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def grams(text):
    """The n-grams of 1 to 3 characters as they are hashed, one set for each length; numbers wrap at 32 bits."""
    from voxelgrove.llm.language_id import BUCKETS

    points, out = [ord(c) for c in text.lower()], []
    for n, size in enumerate(BUCKETS, 1):
        found = set()
        for i in range(len(points) - n + 1):
            code = points[i]
            for p in points[i + 1 : i + n]:
                code = (code * 0x01000193 + p) % (1 << 32)
            found.add((code * 0x9E3779B1) % (1 << 32) >> (33 - size.bit_length()))
        out.append(found)
    return out


def kernel(a, b):
    common, own = (sum(len(x & y) for x, y in zip(p, q, strict=True)) for p, q in ((a, b), (a, a)))
    return common / np.sqrt(own * sum(len(y) for y in b)) if own and any(b) else 0.0


def test_language_kernels_and_regression_by_brute_force(spark):
    from voxelgrove.llm import language_id as L
    from voxelgrove.llm.common import held_out

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where(~held_out("doc_id"))
    model = L.fit(train, landmarks=12)
    rows = [r for r in train.collect() if r.lang is not None and r.text is not None]
    texts = [r.text[:3000] for r in rows[:12]] + ["", "!!!", "aé漢😀", "x"]
    flags, sets = np.zeros(L.EDGES[-1], np.uint8), []
    for t in texts[:5]:
        at = L.mark(t, flags)
        sets.append(np.flatnonzero(flags).astype(np.int32))
        flags[at] = 0
    want = np.array([[kernel(grams(a), grams(b)) for b in texts[:5]] for a in texts])
    assert np.allclose(L.Landmarks.of(sets).kernels(texts), want, atol=1e-5) and want.max() == 1.0
    # Ridge regression on the landmarks' map, solved as one system in the landmarks' own weights.
    marks = model.landmarks
    kept = sorted({tuple(np.flatnonzero(c)) for c in marks.matrix.T})
    landmark = [[set(int(x) - int(a) for x in marks.buckets[list(k)] if a <= x < b) for a, b in zip(L.EDGES, L.EDGES[1:], strict=False)] for k in kept]
    hashed = [grams(r.text) for r in rows]
    k_nm = np.array([[kernel(d, m) for m in landmark] for d in hashed])
    k_mm = np.array([[kernel(a, b) for a in landmark] for b in landmark])
    y = np.array([[1.0 if r.lang == x else -1.0 for x in model.languages] for r in rows])
    alpha = np.linalg.solve(k_nm.T @ k_nm + L.RIDGE * len(rows) / 100 * k_mm, k_nm.T @ y)
    f = k_nm @ alpha
    e = np.exp(L.SHARPNESS * (f - f.max(axis=1, keepdims=True)))
    p = e / e.sum(axis=1, keepdims=True)
    lang, score = model.predict([r.text for r in rows])
    letters = [k for k, r in enumerate(rows) if L.has_letter(r.text)]
    assert [lang[k] for k in letters] == [model.languages[p[k].argmax()] for k in letters]
    assert np.allclose([score[k] for k in letters], p.max(axis=1)[letters], atol=2e-3)


def test_toxicity_held_out_by_language(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = [r for r in op8_toxicity(spark, LARGER).collect() if r.held_out and r.doc_id in truth]
    english = [r.toxic for r in rows if truth[r.doc_id] and lang[r.doc_id] == "en"]
    others = [r.toxic for r in rows if truth[r.doc_id] and lang[r.doc_id] != "en"]
    assert np.mean(english) > 0.85 and np.mean(others) > 0.85
    assert np.mean([r.toxic for r in rows if not truth[r.doc_id]]) < 0.03


def bucket(word):
    raw = word.encode()
    return int(span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])


def words_of(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def test_chain_against_a_loop_over_words(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity_chain.fit(docs, labels, None, "text", "doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity_chain.score_toxicity(docs, labels, keep=["doc_id"]).collect()}
    for r in docs.collect()[:300]:
        found, p = {bucket(w) >> (64 - toxicity_chain.WORD_BITS) for w in words_of(r.text)}, []
        for link in chain.links:
            k = len(link.words)
            z = sum(w for b, w in zip(link.words.tolist(), link.weights, strict=False) if b in found) + sum(w * x for w, x in zip(link.weights[k:], p, strict=False)) + link.weights[-1]
            p.append(1 / (1 + math.exp(-min(30, max(-30, z)))))
        own = [got[r.doc_id][f"p_{c}"] for c in chain.names]
        assert np.allclose(own, p) and got[r.doc_id].toxic == int(own[-1] >= chain.threshold)


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p, y = rng.integers(0, 8, 30) / 8, rng.integers(0, 2, 30).astype(float)
        f1 = lambda t: 2 * (y * (p >= t)).sum() / ((p >= t).sum() + max(1, y.sum()))  # noqa: E731, B023
        assert np.isclose(f1(toxicity_chain.best_threshold(p, y)), max(f1(t) for t in np.unique(p)))


def test_machine_against_all_pairs(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_fm.fit(labels, docs)
    got = {r.doc_id: r.score for r in quality_fm.score(docs, model, keep=["doc_id"]).collect()}
    for r in [r for r in docs.collect() if len(r.text) < 1500][:40]:
        raw = np.frombuffer(r.text.encode(), np.uint8)
        bins = text_features(raw, np.array([0, len(raw)]), quality_fm.WORD_BITS)[2][0]
        buckets = {bucket(w) >> (64 - quality_fm.WORD_BITS) for w in words_of(r.text)}
        x = {(1 << quality_fm.WORD_BITS) + k * BINS + int(b): 1.0 for k, b in enumerate(bins)} | {b: len(buckets) ** -0.5 for b in buckets}
        at = list(x)
        pairs = sum(float(model.v[a] @ model.v[b]) * x[a] * x[b] for i, a in enumerate(at) for b in at[:i])
        z = model.w0 + sum(float(model.w[a]) * x[a] for a in at) + pairs
        assert np.isclose(got[r.doc_id], 1 / (1 + np.exp(-z)), atol=1e-4)


def test_the_sample_is_bounded_in_bytes(spark):
    from voxelgrove.llm.common import within_bytes

    t = spark.range(100).selectExpr("id", "repeat('x', 10) as x")
    rows = within_bytes(t, ["id"], F.octet_length("x"), 305).collect()
    assert len(rows) == 30 and within_bytes(t, ["id"], F.octet_length("x"), 10_000).count() == 100


def test_interactions_in_linear_time_are_those_by_pairs():
    rng = np.random.default_rng(0)
    m = Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    cols, vals = np.array([3, 7, 20, 41]), np.array([1.0, 0.5, 2.0, 0.25])
    pairs = sum((m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(zip(cols, vals, strict=True)) for b, y in list(zip(cols, vals, strict=True))[i + 1 :])
    assert np.isclose(m.sums(np.array([0, 4]), cols, vals)[0][0], 0.3 + m.w[cols] @ vals + pairs)


def test_features_don_t_depend_on_the_slice():
    texts = [b"A b c. A", b"", b"x y\nx y\nz", "é ü".encode()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows, buckets, stats = text_features(np.frombuffer(b"".join(texts), np.uint8), at, 12)
    for k, t in enumerate(texts):
        _, b, s = text_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 12)
        assert buckets[rows == k].tolist() == b.tolist() and stats[k].tolist() == s[0].tolist()


def test_long_texts_give_the_same_features_in_pieces(monkeypatch):
    from voxelgrove.llm import bytetext, features

    rng = np.random.default_rng(5)
    raw = "".join(rng.choice(["ab", "c", " ", "\n", "é"], size=4000)).encode()
    data, at = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    whole = text_features(data, at, 14)
    monkeypatch.setattr(bytetext, "BLOCK", 7)
    monkeypatch.setattr(features, "BLOCK", 7)
    monkeypatch.setattr(bytetext, "_powers", [])
    assert all((a == b).all() for a, b in zip(whole, text_features(data, at, 14), strict=True))


def test_bytes_are_bounded_as_by_a_walk_over_all_hashes(spark):
    from voxelgrove.llm.common import within_bytes

    rows = [(k % 60, "x" * (k % 7)) for k in range(200)] + [(5, "x" * 9)] * 300
    t = spark.createDataFrame(rows, "id long, x string")
    hashed = sorted((r[0], r[1]) for r in t.select(F.xxhash64(F.col("id").cast("string"), F.lit(29)), F.octet_length("x")).collect())
    for most in (0, 40, 300, 900, 3000, 10_000):
        seen, last = 0, None
        for h, n in hashed:
            seen += n
            if seen > most:
                last = h
                break
        want = [n for h, n in hashed if last is None or h < last]
        got = [len(r.x) for r in within_bytes(t, ["id"], F.octet_length("x"), most).collect()]
        assert sorted(got) == sorted(want) and sum(got) <= most
    assert within_bytes(t.limit(0), ["id"], F.octet_length("x"), 10).count() == 0
