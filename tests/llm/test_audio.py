import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrove.llm import audio_fingerprint as A


def melody(seed, notes):
    rng = np.random.default_rng(seed)
    t = np.arange(400) / 8000
    return np.concatenate([sum(np.sin(2 * np.pi * 660 * 2 ** (k / 12) * t) for k in rng.integers(0, 24, 4)) / 4 for _ in range(notes)])


def wav(x, kind=1, bits=16, rate=8000, channels=1, extended=False):
    x = np.repeat(x, channels)
    if kind == 3:
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = (x * 127 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        data = (x * 8388607).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        data = (x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    size = bits // 8 * channels
    head = struct.pack("<HHIIHH", 0xFFFE if extended else kind, channels, rate, rate * size, size, bits)
    if extended:
        head += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + b"\0" * 14
    return b"RIFF" + struct.pack("<I", 28 + len(head) + len(data)) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize(("kind", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
@pytest.mark.parametrize("extended", [False, True])
def test_kinds_of_samples(kind, bits, extended):
    x = np.linspace(-0.9, 0.9, 77)
    for channels in (1, 2):
        got = A.decode(wav(x, kind, bits, channels=channels, extended=extended))
        assert len(got) == 77 and np.abs(got - x).max() < 0.01


def test_other_media():
    assert np.allclose(A.decode(bytes([0, 128, 255])), [-1, 0, 127 / 128])
    assert len(A.decode(wav(np.zeros(9), kind=6, bits=8))) == 0 and len(A.decode(b"RIFF0000WAVE")) == 0
    t = np.arange(44100) / 44100
    got = A.decode(wav(0.5 * np.sin(2 * np.pi * 440 * t), rate=44100))
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    assert len(got) == 8000 and np.corrcoef(got, want)[0, 1] > 0.99


@pytest.mark.parametrize("to", [A.AUDIO, A.TEXTS])
def test_every_semitone_has_a_class_of_its_own(to):
    assert (to.pitch > 0).any(axis=0).all()
    t = np.arange(4 * to.frame) / to.rate
    for k in range(12):
        frames, _ = A.chroma([np.sin(2 * np.pi * 1100 * 2 ** (k / 12) * t)], to)
        assert frames[0].argmax() == int(round(12 * np.log2(1100 / 440) + k)) % 12


def test_filters_against_sums():
    frames = np.random.default_rng(1).random((40, 12)).astype(np.float32)
    got = A.filter_values(frames)
    for i in (0, 7, 25):
        for k, (kind, p, h, w) in enumerate(A.FILTERS):
            x, q = frames[i : i + w].astype(float), p + h
            whole = x[:, p:q].sum()
            part = {
                0: whole,
                1: x[:, p + h // 2 : q].sum(),
                2: x[w // 2 :, p:q].sum(),
                3: x[: w // 2, p : p + h // 2].sum() + x[w // 2 :, p + h // 2 : q].sum(),
                4: x[:, p + h // 3 : p + h - h // 3].sum(),
                5: x[w // 3 : w - w // 3, p:q].sum(),
            }[kind]
            rest = x.sum() - whole if kind == 0 else whole - part
            assert np.isclose(got[i, k], np.log((1 + part) / (1 + rest)), atol=1e-3)


def test_recordings_align_at_their_offset(spark):
    base, hop = melody(1, 60), A.TEXTS.hop
    cut = base[hop * 100 : hop * 500]
    noisy = base + np.random.default_rng(2).normal(0, 0.01, len(base))
    rows = [(0, wav(base / 2)), (1, wav(cut / 2)), (2, wav(noisy / 2)), (3, wav(melody(5, 60) / 2)), (4, wav(base / 2)), (5, b""), (6, None), (7, wav(base / 2, 3, 32))]
    rows += [(k, wav(melody(k, 40) / 2)) for k in range(10, 40)]
    found = {r.id: r for r in A.align_recordings(spark.createDataFrame(rows, "id long, media binary"), F.col("id") == 0, to=A.TEXTS, block=700).collect()}
    assert [(m.query, m.offset) for m in found[1].matches] == [(0, 100)]
    assert [(m.query, m.offset) for m in found[2].matches] == [(0, 0)]
    assert found[4].class_id == 0 and found[4].matches == []
    assert {k: found[k].matches for k in (3, 5, 6, *range(10, 40)) if found[k].matches} == {}


def prints(texts, to=A.TEXTS):
    signals = [A.decode(t.encode()) for t in texts]
    frames, begins = A.chroma(signals, to)
    values = A.filter_values(frames)
    ok = np.concatenate([np.arange(a, max(a, b - A.WIDEST + 1)) for a, b in zip(begins, begins[1:], strict=False)])
    thresholds = np.quantile(values[ok], [0.25, 0.5, 0.75], axis=0).T
    return signals, thresholds, [c for c, _ in A.fingerprints(signals, thresholds, to)]


def block(asks, thresholds):
    return A.Block([(i, c, o) for i, x in asks for c, o in A.fingerprints([x[8 * p :] for p in range(A.PHASES)], thresholds, A.TEXTS)])


def test_recall_on_planted_cuts_noise_and_edits(spark, sf):
    rng = np.random.default_rng(0)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and 2200 < len(r.text.encode()) < 20_000][:60]
    signals, thresholds, _ = prints(texts)
    index, found = block(enumerate(signals), thresholds), {"cut": [], "noise": [], "edits": []}
    for k, x in enumerate(signals):
        a = int(rng.integers(0, len(x) // 3))
        made = {"cut": x[a : a + max(1100, len(x) // 2)], "noise": x + rng.normal(0, 0.01, len(x)).astype(np.float32), "edits": np.where(rng.random(len(x)) < 0.005, np.float32(-0.2), x)}
        for kind, y in made.items():
            offsets = [o for q, o, _, _ in index.align(A.fingerprints([y], thresholds, A.TEXTS)[0][0]) if q == k]
            found[kind].append(any(abs(o - (a / 32 if kind == "cut" else 0)) < 2 for o in offsets))
    assert len(signals) >= 20 and all(np.mean(x) >= 0.9 for x in found.values()), {k: np.mean(x) for k, x in found.items()}


def test_recall_against_a_scan_of_all_offsets(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    signals, thresholds, codes = prints([t for _, t in docs])
    asks = [(i, x, c) for (i, _), x, c in zip(docs, signals, codes, strict=True) if i % 50 == 0 and 8 <= len(c) < 300]
    index, want, got = block([(i, x) for i, x, _ in asks], thresholds), set(), set()
    for (i, _), y in zip(docs, codes, strict=True):
        if len(y) >= 300:
            continue
        got |= {(q, i) for q, *_ in index.align(y) if q != i}
        for q, _, x in asks:
            for o in range(A.LEAST_OVERLAP - len(y), len(x) - A.LEAST_OVERLAP + 1) if q != i else ():
                a, b = max(0, -o), min(len(y), len(x) - o)
                if b - a >= A.LEAST_OVERLAP and np.bitwise_count(x[a + o : b + o] ^ y[a:b]).mean() / 32 <= A.MOST_BIT_ERRORS:
                    want.add((q, i))
                    break
    assert want and len(got & want) >= 0.9 * len(want), (len(got & want), len(want))


def test_recordings_are_looked_up_together(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 1 << 32, int(n), dtype=np.uint32) for n in rng.integers(8, 90, 60)]
    # Cuts and copies with flipped bits, silence, a pattern that repeats its keys, and recordings that only make a key together.
    texts += [np.concatenate([t[5:], texts[3]]) ^ (rng.random(len(t) - 5 + len(texts[3])) < 0.1).astype(np.uint32) for t in texts[:20]]
    texts += [np.zeros(50, np.uint32), np.tile(texts[0][:4], 30), texts[7][:5], texts[7][5:], np.zeros(0, np.uint32), texts[9].copy()]
    asks = [(i, np.roll(texts[i], -p), np.vstack([np.roll(texts[i], -p) ^ np.uint32(1), np.roll(texts[i], -p) ^ np.uint32(4)])) for i in (*range(12), 80, 81) for p in range(2)]
    index = A.Block(asks)

    def plain(codes):
        hits, out = {}, {}
        for e, (_, c, other) in enumerate(asks):
            for k, a in zip(*A.query_keys(c, other), strict=True):
                hits.setdefault(int(k), []).append((e, int(a)))
        own = A._pairs(codes, codes).tolist() if len(codes) > 3 else []
        offsets = {}
        for at, k in enumerate(own):
            if at == 0 or own[at - 1] != k:
                for e, a in hits.get(k, []):
                    offsets.setdefault((e, a - at), []).append(at)
        for (e, o), places in offsets.items():
            x, a, b = asks[e][1], max(0, -o), min(len(codes), len(asks[e][1]) - o)
            if len(places) < A.LEAST_HITS or b - a < A.LEAST_OVERLAP:
                continue
            wrong = [(int(x[k + o]) ^ int(codes[k])).bit_count() for k in range(a, b)]
            error = sum(wrong) / len(wrong) / 32
            if error > A.MOST_BIT_ERRORS and max(places) + 4 - min(places) >= A.LEAST_STRETCH:
                part = wrong[min(places) - a : max(places) + 4 - a]
                error = sum(part) / len(part) / 32
            if error <= A.MOST_BIT_ERRORS:
                out.setdefault(asks[e][0], []).append((error, o, len(places)))
        kept = []
        for q, found in out.items():
            best = []
            for error, o, n in sorted(found):
                if all(abs(o - p) >= A.WIDEST for p in best):
                    best.append(o)
                    kept.append((q, o, n, error))
        return sorted(kept)

    want = [plain(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert sum(map(bool, want)) > 30 and max(map(len, want)) > 1
    for most in (1, 50, A.MOST_HITS):
        monkeypatch.setattr(A, "MOST_HITS", most)
        assert dict(index.align_all(np.concatenate(texts), begins)) == {k: w for k, w in enumerate(want) if w}
    others = {k: [m for m in w if m[0] != k] for k, w in enumerate(want)}
    assert dict(index.align_all(np.concatenate(texts), begins, list(range(len(texts))))) == {k: w for k, w in others.items() if w}
    assert [index.align(t) for t in texts] == want
    assert list(A.Block([]).align_all(np.concatenate(texts), begins)) == []
    # What shares nothing with the block costs no work of its own: this took as long as one lookup for each recording.
    many = rng.integers(0, 1 << 32, 400_000, dtype=np.uint32)
    begins, began = np.arange(0, len(many) + 1, 40), time.perf_counter()
    assert list(index.align_all(many, begins)) == []
    together, began = time.perf_counter() - began, time.perf_counter()
    assert not any(index.align(many[a : a + 40]) for a in begins[:500])
    assert together < (time.perf_counter() - began) * 20 / 4


def test_thresholds_are_quartiles_of_all_places_of_all_recordings(spark):
    rng = np.random.default_rng(3)
    # Many short recordings and some long ones, with empty and null ones between them.
    texts = [bytes(rng.integers(32, 32 + int(rng.integers(8, 95)), int(rng.integers(1, 400)))).decode() for _ in range(1700)]
    texts += [bytes(rng.integers(32, 126, n)).decode() for n in (3000, 9000, 30_000)] + ["", "a", "aaaa"]
    rows = [(i, t.encode()) for i, t in enumerate(texts)] + [(-1, None), (None, b"")]
    recordings = spark.createDataFrame(rows, "id long, media binary")
    want = prints(texts)[1]
    for n in (1, 7):
        assert (A.fit_thresholds(recordings.repartition(n), to=A.TEXTS) == want).all()
    assert (A.fit_thresholds(recordings.where("id < 0"), to=A.TEXTS) == 0).all()


def test_quartiles_from_counts():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 4, 5, 50, 1001):
        x = rng.integers(-9, 10, size)
        step, n = np.unique(x, return_counts=True)
        order = rng.permutation(len(step))
        assert A.quartiles(step[order], n[order]) == np.quantile(x, [0.25, 0.5, 0.75]).tolist()


def test_filters_stay_in_the_counted_range():
    loud = np.zeros((A.WIDEST, A.CLASSES), np.float32)
    for p in range(A.CLASSES):
        for q in range(p + 1, A.CLASSES + 1):
            loud[:] = 0
            loud[:, p:q] = (q - p) ** -0.5
            assert np.abs(A.filter_values(loud)).max() * A.STEPS <= A.MOST_STEPS
