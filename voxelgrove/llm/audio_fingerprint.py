"""Chroma audio fingerprints and the alignment of recordings by them.

A recording becomes frames of energy in 12 pitch classes. Rectangle filters over (time, pitch class), summed through an integral image, compare areas of
that picture; each filter's value is quantised to two bits at its quartiles over all places of all recordings, and 16 filters make one 32-bit integer a frame. Two recordings align where several
equal integers have the same offset; the share of differing bits over the overlap, or over the stretch between the first and the last of them, decides.

What is looked up is an integer with the one three frames on. As a cut may fall between two frames, a query is looked up from ``PHASES`` places within the first hop, and with the
quantised values changed that lie nearest to a quartile, as noise changes these first. Queries are looked up in blocks of bounded size against all recordings; recordings with equal fingerprints are one class.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, blob, slices, written

CLASSES = 12
#: Queries' integers in a block, of all phases: with all keys, their places and bits about 130 MB on a worker.
BLOCK = 3 << 18
PHASES = 4
LEAST_HITS = 3
#: Bits for each key of a block, at least, and equal keys of recordings and queries that are gone through at once.
SPARSE = 32
MOST_HITS = 1 << 20
LEAST_OVERLAP = 8
#: Of a stretch chosen by its equal integers more is asked than of a whole overlap.
LEAST_STRETCH = 32
MOST_BIT_ERRORS = 0.15
#: Copies of the few-rows-a-key side where classes are joined to their members.
SALTS = 32

#: (kind, first pitch class, pitch classes, frames) of the 16 filters, by a rule that varies place and size.
FILTERS = tuple((k % 6, (5 * k) % 7, 2 + 2 * (k % 3 == 0) + (k % 4), (4, 6, 9, 12, 15)[k % 5]) for k in range(16))
WIDEST = max(w for *_, w in FILTERS)
#: Odd, so that no two keys become one by it.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Steps of 1 in the integral image.
UNIT = 1 << 16
#: Steps of 1 in filters' values. These are whole steps, so their quartiles follow from counts.
STEPS = 1 << 12
#: Steps that no value of normed frames is beyond, either way.
MOST_STEPS = int(np.ceil(np.log(1 + WIDEST * (CLASSES**0.5 + CLASSES / UNIT)) * STEPS))
#: Frames that a recording has at least; a shorter one is repeated from its beginning.
LEAST_FRAMES = WIDEST + LEAST_OVERLAP - 1


@dataclass(frozen=True)
class Settings:
    """Samples a second, and samples of a frame and between frames."""

    rate: int = 8000
    frame: int = 2048
    hop: int = 256

    @cached_property
    def pitch(self) -> np.ndarray:
        """Frequencies x 12. Frequencies below the one from which a semitone is wider than a bin are left out, so every pitch class has bins of its own."""
        m = np.zeros((self.frame // 2 + 1, CLASSES), np.float32)
        lowest = int(np.ceil(1 / (2 ** (1 / 12) - 1)))
        for k in range(lowest, len(m)):
            m[k, int(round(12 * np.log2(k * self.rate / self.frame / 440.0))) % CLASSES] = 1
        return m / np.maximum(1, m.sum(axis=0))

    @cached_property
    def window(self) -> np.ndarray:
        return np.hanning(self.frame).astype(np.float32)


AUDIO = Settings()
#: Texts are short: frames of a few dozen milliseconds.
TEXTS = Settings(frame=256, hop=32)

#: Kinds of samples in the format's header, and the one that names the kind further on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def _samples(data: bytes, kind: int, bits: int) -> np.ndarray | None:
    """Numbers from -1 to 1; None of a kind that is not known."""
    if kind == PCM and bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    if kind == PCM and bits == 24:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / np.float32(1 << 31)).astype(np.float32)
    if kind == PCM and bits in (16, 32):
        return (np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], f"<i{bits // 8}") / np.float32(1 << (bits - 1))).astype(np.float32)
    if kind == FLOAT and bits in (32, 64):
        x = np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(np.float32)
        return np.clip(np.nan_to_num(x), -1, 1)
    return None


def resample(x: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """To another rate: a moving mean as long as the step takes away what the new rate can't hold, then values between samples are linear."""
    if rate == wanted or not len(x):
        return x
    n = max(1, int(round(len(x) * wanted / rate)))
    width = int(round(rate / wanted))
    if width > 1:
        sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        low, high = np.maximum(0, np.arange(len(x)) - width // 2), np.minimum(len(x), np.arange(len(x)) - width // 2 + width)
        x = ((sums[high] - sums[low]) / (high - low)).astype(np.float32)
    return np.interp(np.arange(n) * (rate / wanted), np.arange(len(x)), x).astype(np.float32)


def decode(media: bytes, rate: int = AUDIO.rate) -> np.ndarray:
    """Samples from -1 to 1 at ``rate``, the mean of the channels: of a WAV file (8, 16, 24 or 32-bit integers, 32 or 64-bit floats), or of raw unsigned 8-bit PCM at that rate. A WAV file of another kind has none."""
    if media[:4] == b"RIFF" and media[8:12] == b"WAVE":
        at, kind, channels, own, bits = 12, PCM, 1, rate, 8
        while at + 8 <= len(media):
            name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
            if name == b"fmt " and at + 24 <= len(media):
                kind, channels, own = struct.unpack("<HHI", media[at + 8 : at + 16])
                bits = struct.unpack("<H", media[at + 22 : at + 24])[0]
                if kind == EXTENSIBLE and size >= 26 and at + 34 <= len(media):
                    kind = struct.unpack("<H", media[at + 32 : at + 34])[0]
            if name == b"data":
                x = _samples(media[at + 8 : at + 8 + size], kind, bits)
                if x is None or not channels or not own:
                    break
                return resample(x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), own, rate)
            at += 8 + size + size % 2
        return np.zeros(0, np.float32)
    return (np.frombuffer(media, np.uint8).astype(np.float32) - 128) / 128


def chroma(signals: list[np.ndarray], to: Settings = AUDIO) -> tuple[np.ndarray, np.ndarray]:
    """Frames x 12 of all recordings, one after the other, and where each recording's begin. A recording has at least LEAST_FRAMES, repeated from its beginning if it is shorter; an empty one none."""
    counts = [max(LEAST_FRAMES, 1 + max(0, len(s) - to.frame) // to.hop) if len(s) else 0 for s in signals]
    begins = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = np.zeros((begins[-1], CLASSES), np.float32)
    at = 0
    for s, n in zip(signals, counts, strict=True):
        need = (n - 1) * to.hop + to.frame
        padded = s if len(s) >= need else np.resize(s, need) if n else s
        for i in range(0, n, 4096):
            m = min(4096, n - i)
            frames = np.lib.stride_tricks.as_strided(padded[i * to.hop :], (m, to.frame), (padded.strides[0] * to.hop, padded.strides[0]))
            spectrum = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * to.window, axis=1)
            energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ to.pitch
            norm = np.sqrt((energy * energy).sum(axis=1, keepdims=True))
            out[at + i : at + i + m] = np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0)
        at += n
    return out, begins


def filter_values(frames: np.ndarray) -> np.ndarray:
    """(frames - WIDEST + 1) x 16 of one recording's frames, or of several in a row (places that straddle two are for the caller to leave out)."""
    n = len(frames) - WIDEST + 1
    # In whole numbers, so that a recording's values don't depend on what lies before it.
    image = np.zeros((len(frames) + 1, CLASSES + 1), np.int64)
    image[1:, 1:] = np.rint(frames.astype(np.float64) * UNIT).astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    t = np.arange(max(0, n))

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return (image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]) / UNIT

    out = np.empty((max(0, n), len(FILTERS)))
    for k, (kind, p, h, w) in enumerate(FILTERS):
        q = p + h
        whole = area(0, w, p, q)
        if kind == 0:
            part = whole
            rest = area(0, w, 0, CLASSES) - whole
        elif kind == 1:
            part = area(0, w, p + h // 2, q)
            rest = whole - part
        elif kind == 2:
            part = area(w // 2, w, p, q)
            rest = whole - part
        elif kind == 3:
            part = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, q)
            rest = whole - part
        elif kind == 4:
            part = area(0, w, p + h // 3, p + h - h // 3)
            rest = whole - part
        else:
            part = area(w // 3, w - w // 3, p, q)
            rest = whole - part
        out[:, k] = np.log((1 + part) / (1 + rest))
    return np.rint(out * STEPS) / STEPS


def fingerprints(signals: list[np.ndarray], thresholds: np.ndarray, to: Settings = AUDIO) -> list[tuple[np.ndarray, np.ndarray]]:
    """uint32 integers of each recording, and the same with the two least certain values changed (2 x integers); thresholds: 16 x 3."""
    frames, begins = chroma(signals, to)
    values = filter_values(frames)
    codes, other, margin = np.zeros(len(values), np.uint32), np.zeros((len(FILTERS), len(values)), np.uint32), np.empty((len(FILTERS), len(values)))
    for k, t in enumerate(thresholds):
        level = np.searchsorted(t, values[:, k])
        gap = np.abs(values[:, k][:, None] - t)
        near = gap.argmin(axis=1)
        margin[k] = gap[np.arange(len(values)), near] / max(1e-9, t[2] - t[0])
        codes |= GRAY[level] << np.uint32(2 * k)
        other[k] = (GRAY[level] ^ GRAY[np.where(near < level, near, near + 1)]) << np.uint32(2 * k)
    least = np.argsort(margin, axis=0, kind="stable")[:2]
    changed = codes ^ np.take_along_axis(other, least, axis=0)
    return [(codes[a : max(a, b - WIDEST + 1)], changed[:, a : max(a, b - WIDEST + 1)]) for a, b in zip(begins, begins[1:], strict=False)]


def _signals(column: pa.Array, rate: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    for a, b in slices(at, SLICE_BYTES):
        yield a, b, [decode(x or b"", rate) for x in column.slice(a, b - a).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a binary column without nulls, and where each row's begin."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] :] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def quartiles(step: np.ndarray, n: np.ndarray) -> list[float]:
    """Quartiles, as numpy's, of numbers that occur ``n`` times each."""
    order = np.argsort(step)
    step, upto = step[order], np.cumsum(n[order])
    out = []
    for k in (1, 2, 3):
        place, rest = divmod((int(upto[-1]) - 1) * k, 4)
        low, high = step[np.searchsorted(upto, [place, place + (rest > 0)], side="right")]
        out.append(float(low + (high - low) * rest / 4))
    return out


def fit_thresholds(recordings: DataFrame, to: Settings = AUDIO) -> np.ndarray:
    """Quartiles of each filter's values over all places of all recordings: 16 x 3.

    Tasks count values; the driver gets at most 2 * MOST_STEPS + 1 counts of a filter, whatever the recordings.
    """
    span = 2 * MOST_STEPS + 1
    begin = np.arange(len(FILTERS)) * span + MOST_STEPS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(FILTERS) * span, np.int64)
        for b in batches:
            for _, _, signals in _signals(b.column(0), to.rate):
                frames, begins = chroma(signals, to)
                steps = np.rint(filter_values(frames) * STEPS).astype(np.int64) + begin
                # Without the places that straddle two recordings.
                own = np.ones(len(steps), bool)
                for x in begins[1:-1]:
                    own[max(0, x - WIDEST + 1) : x] = False
                seen += np.bincount(steps[own].ravel(), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    counted = recordings.where("media is not null").select("media").mapInArrow(count, "at long, n long")
    found = counted.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    if not len(at):
        return np.zeros((len(FILTERS), 3))
    k, step = at // span, at % span - MOST_STEPS
    return np.array([quartiles(step[k == f], n[k == f]) for f in range(len(FILTERS))]) / STEPS


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys: each integer of ``a`` with the one of ``b`` three frames on, one to one spread over all 64-bit numbers, so that the high bits tell keys apart."""
    out = a[:-3].astype(np.uint64)
    out <<= np.uint64(32)
    out |= b[3:]
    out *= SPREAD
    return out


def _fresh(keys: np.ndarray) -> np.ndarray:
    """Places of the first of each run of equal keys."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first)


def query_keys(codes: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their places: each integer with the one three frames on, and with the least certain values of either changed."""
    keys, places = [], []
    for a, b in ((codes, codes), (changed[0], codes), (changed[1], codes), (codes, changed[0]), (codes, changed[1]), (changed[0], changed[0])):
        found = _pairs(a, b)
        at = _fresh(found)
        keys.append(found[at])
        places.append(at.astype(np.int32))
    return np.concatenate(keys), np.concatenate(places)


def _bits(at: np.ndarray, size: np.uint64) -> np.ndarray:
    """2**size bits of which those at ``at`` are set."""
    bits = np.zeros(1 << (int(size) - 3), np.uint8)
    np.bitwise_or.at(bits, (at >> np.uint64(3)).view(np.int64), np.uint8(1) << (at.astype(np.uint8) & np.uint8(7)))
    return bits


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[(at >> np.uint64(3)).view(np.int64)] >> (at.astype(np.uint8) & np.uint8(7)) & np.uint8(1)


class Block:
    """Queries' keys in order, with the query and place of each; a query has one entry for each phase."""

    def __init__(self, queries: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids, self.codes = [q[0] for q in queries], [q[1] for q in queries]
        found = [query_keys(c, other) for _, c, other in queries] or [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        counts, keys, place = [len(k) for k, _ in found], np.concatenate([k for k, _ in found]), np.concatenate([a for _, a in found])
        del found
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        del keys
        self.place = place[order]
        self.query = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k != "known"}

    @cached_property
    def known(self) -> tuple[np.uint64, list[np.ndarray]]:
        """By how much to shift a key to its first bit, and the bits of all keys by two parts of a key: of either at most one of ``SPARSE`` is set. Made where it is used, not shipped."""
        size = np.uint64(max(10, (len(self.keys) * SPARSE - 1).bit_length()))
        return np.uint64(64) - size, [_bits(self.keys >> (np.uint64(64) - size), size), _bits(self.keys << size >> (np.uint64(64) - size), size)]

    def found(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of recordings one after the other: the recording and place of each of their keys that the block has, in order, and where its entries begin and end. Of a run of equal keys only the first.

        All keys are looked up in the bits at once; only what is found there is searched for.
        """
        (shift, (first, second)), keys = self.known, _pairs(codes, codes)
        at = np.flatnonzero(_set(first, keys >> shift))
        at = at[_set(second, keys[at] << (np.uint64(64) - shift) >> shift).astype(bool)]
        own = np.searchsorted(begins, at, side="right") - 1
        fresh = (at == begins[own]) | (keys[at] != keys[at - 1])
        inside = fresh & (at + 3 < begins[own + 1])
        at, own = at[inside], own[inside]
        low, high = (np.searchsorted(self.keys, keys[at], side=side) for side in ("left", "right"))
        same = high > low
        return own[same], (at - begins[own])[same], low[same], high[same]

    def align(self, codes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset, hits, bit error) of the queries that align with a recording: place in the query is place in the recording plus offset. Of offsets that share frames the best one."""
        return dict(self.align_all(codes, np.array([0, len(codes)]))).get(0, [])

    def align_all(self, codes: np.ndarray, begins: np.ndarray, own_ids: list | None = None) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
        """``align`` of recordings one after the other: the number of each that a query aligns with, but for the query of its own id, and what aligns."""
        rec, place, low, high = self.found(codes, begins)
        upto = np.concatenate([[0], np.cumsum(np.bincount(rec, weights=high - low, minlength=len(begins) - 1))]).astype(np.int64)
        for a, b in slices(upto, MOST_HITS):
            if upto[b] - upto[a] < LEAST_HITS:
                continue
            i, j = np.searchsorted(rec, [a, b])
            many = (high - low)[i:j]
            hit = np.repeat(low[i:j] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            at, own, query = np.repeat(rec[i:j], many), np.repeat(place[i:j], many), self.query[hit]
            pairs = (query.astype(np.int64) << 32) + (self.place[hit] - own) + (1 << 31)
            order = np.lexsort((pairs, at))
            pairs, at, own = pairs[order], at[order], own[order]
            begin = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (at[1:] != at[:-1])]))
            hits = np.diff(np.append(begin, len(pairs)))
            first, last = own[begin], own[begin + hits - 1] + 4
            kept: dict[int, dict[int, list[tuple[float, int, int]]]] = {}
            for k in np.flatnonzero(hits >= LEAST_HITS).tolist():
                r, q, o = int(at[begin[k]]), int(pairs[begin[k]]) >> 32, (int(pairs[begin[k]]) & 0xFFFFFFFF) - (1 << 31)
                if own_ids is not None and own_ids[r] == self.ids[q]:
                    continue
                errors = self.errors(q, o, codes[begins[r] : begins[r + 1]], int(first[k]), int(last[k]))
                if errors <= MOST_BIT_ERRORS:
                    kept.setdefault(r, {}).setdefault(self.ids[q], []).append((errors, o, int(hits[k])))
            for r, queries in kept.items():
                out = []
                for q, offsets in queries.items():
                    best: list[int] = []
                    for errors, o, n in sorted(offsets):
                        if all(abs(o - p) >= WIDEST for p in best):
                            best.append(o)
                            out.append((q, o, n, errors))
                yield r, sorted(out, key=lambda m: (m[0] is None, m))

    def errors(self, q: int, o: int, codes: np.ndarray, first: int, last: int) -> float:
        """The share of differing bits of the overlap of query and recording, or of the stretch from ``first`` to ``last`` if that is less and long enough; 1 if they overlap too little."""
        x, a, b = self.codes[q], max(0, -o), min(len(codes), len(self.codes[q]) - o)
        if b - a < LEAST_OVERLAP:
            return 1.0
        wrong = np.bitwise_count(x[a + o : b + o] ^ codes[a:b])
        errors = int(wrong.sum()) / len(wrong) / 32
        if errors > MOST_BIT_ERRORS and last - first >= LEAST_STRETCH:
            errors = int(wrong[first - a : last - a].sum()) / len(wrong[first - a : last - a]) / 32
        return errors


MATCH = "array<struct<query: long, offset: long, hits: long, bit_error: double>>"


def align_recordings(recordings: DataFrame, is_query, media: str = "media", id_col: str = "id", block: int = BLOCK, to: Settings = AUDIO) -> DataFrame:
    """A row for each recording: id, n_codes, class_id (least id with the same fingerprint) and matches: the query classes that it aligns with, but for its own.

    ``is_query``: a condition on the column ``id``. Defined cases: null and empty media, and WAV files of an unknown kind, have no fingerprint (n_codes 0, class_id
    its own id, no match); a short recording is repeated until it has integers enough; repeated rows and copies are one class; a null id is no query.
    """
    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(media).cast("binary").alias("media"))
    thresholds = fit_thresholds(rows, to=to)
    marked = rows.select("id", "media", F.coalesce(is_query, F.lit(False)).alias("asks"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, signals in _signals(b.column(1), to.rate):
                found, asking = fingerprints(signals, thresholds, to), [None] * (j - i)
                for k in np.flatnonzero(b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)).tolist():
                    if len(signals[k]):
                        starts = [signals[k][p * to.hop // PHASES :] for p in range(PHASES) if p * to.hop // PHASES < len(signals[k])]
                        asking[k] = [blob(np.vstack([c, other])) for c, other in fingerprints(starts, thresholds, to)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([blob(c) for c, _ in found], pa.binary()), pa.array(asking, pa.list_(pa.binary()))], ["id", "codes", "asking"])

    prints = written(marked.mapInArrow(make, "id long, codes binary, asking array<binary>").withColumn("print", F.when(F.octet_length("codes") > 0, F.xxhash64("codes"))), "fingerprints")
    # Each class is compared once, then its members take over the matches. Copies have equal integers, so any of them, and any that asks, will do.
    some = prints.where("print is not null").groupBy("print").agg(F.min("id").alias("class_id"), F.first("codes").alias("codes"), F.first("asking", ignorenulls=True).alias("asking"))
    once = written(some, "one_of_each_class")
    asking = once.where("asking is not null")
    total = asking.agg(F.sum(F.octet_length("codes") / 4)).first()[0] or 0
    blocks = max(1, -(-int(total) * PHASES // block))
    scans = []
    for k in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("print"), F.lit(blocks)) == k).select("class_id", F.explode("asking"))
        rows = sorted(((r[0], bytes(r[1])) for r in part.collect()), key=lambda q: (q[0] is None, q[0], q[1]))
        index = Block([(i, x[0], x[1:]) for i, x in ((i, np.frombuffer(raw, np.uint32).reshape(3, -1)) for i, raw in rows)])
        shipped = recordings.sparkSession.sparkContext.broadcast(index)

        def probe(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("query", pa.int64()), ("offset", pa.int64()), ("hits", pa.int64()), ("bit_error", pa.float64())]))
            for b in batches:
                raw, at = flat(b.column(1))
                rows, out = [], []
                for i, j in slices(at, SLICE_BYTES):
                    codes, begins = raw[at[i] : at[j]].view(np.uint32), (at[i : j + 1] - at[i]) // 4
                    for r, found in shipped.value.align_all(codes, begins, b.column(0).slice(i, j - i).to_pylist()):
                        rows.append(i + r)
                        out.append([{"query": q, "offset": o, "hits": n, "bit_error": e} for q, o, n, e in found])
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(rows, pa.int64())), pa.array(out, kind)], ["print", "matches"])

        # Written before the next block is collected, so that the driver holds one block at a time.
        scan = once.select("class_id", "codes", "print").mapInArrow(probe, f"print long, matches {MATCH}")
        scans.append(written(scan, f"matches_{k}"))
        shipped.destroy()
    found = scans[0]
    for scan in scans[1:]:
        found = found.union(scan)
    matches = found.groupBy("print").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")) if blocks > 1 else found
    # A large class is one key of its members' prints, so the classes come in SALTS copies; recordings without a print stay apart.
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    of_class = once.select("print", "class_id").join(matches, "print", "left").select("*", copies)
    known = prints.where("print is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(of_class, ["print", "salt"], "left")
    out = known.unionByName(prints.where("print is null"), allowMissingColumns=True)
    none = F.array().cast(MATCH)
    return out.select("id", (F.octet_length("codes") / 4).cast("long").alias("n_codes"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("matches", none).alias("matches"))


def op1_audio_fingerprint(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` as recordings (the UTF-8 bytes of a text as 8-bit PCM), aligned with those whose id is divisible by 50."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    recordings = docs.select("doc_id", F.col("text").cast("binary").alias("media"))
    found = align_recordings(recordings, F.col("id") % 50 == 0, id_col="doc_id", to=TEXTS)
    return found.select(F.col("id").alias("doc_id"), "n_codes", "class_id", F.size("matches").alias("n_matches"), "matches")
